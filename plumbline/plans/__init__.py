"""Planning on the driver, over metadata."""
