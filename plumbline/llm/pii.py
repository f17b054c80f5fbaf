"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from four patterns (e-mail, IP, card, phone), each left to right without overlaps.
Around what may be personal data, a semi-Markov CRF then segments the text: a segment is one chunk
outside of any entity, or up to ``MAX_CHUNKS`` chunks (runs without white space, cut after quotes,
commas, = and the like too) that form one entity of a type. Features look at the whole span: its
shape, digits, separators, checksum, the words before it, how its value mixes letters. A dynamic programme over (position, type) finds the best segmentation, so boundaries and types
are chosen together; its cost is positions x MAX_CHUNKS x types, whatever the text.

The weights are fitted here, once a driver process, by gradient ascent on the likelihood of
generated labelled sentences (``EXAMPLES`` of them, seed fixed), with the forward-backward sums of the
same lattice. They are broadcast: a few thousand numbers.

A card number has to pass its check digit, whoever finds it; a secret's span is its value, without the name
it is given to. Spans that the model adds never overlap base spans or each other. Offsets are code points, end
exclusive.

Defined cases: a null text is the empty text without spans (``redact`` keeps it null); texts are taken
whole; repeated rows are each searched; an empty table gives an empty result. Other columns are not
read by ``find`` and kept as they are by ``redact``, n_chars excepted, which follows the text.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the model adds to these.
TYPES = (*BASE_KINDS, "secret", "iban", "ssn")
OUT = "o"
#: An IBAN in groups of four has nine.
MAX_CHUNKS = 9
EXAMPLES = 400
EPOCHS = 8

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does and takes each whole, so a run is read once; that changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SIGN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, by start, then kind in the order of BASE_KINDS."""
    if not _SIGN.search(text):
        return []
    found: list[tuple[int, int, int]] = []
    free = 0  # an e-mail's local part can't reach into the one before
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            free = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(v) <= 3 and int(v or "0") <= 255 for v in [p.lstrip("0") for p in m[0].split(".")]):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = "".join(_DIGITS.findall(m[0]))
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(BASE_KINDS[k], a, b) for a, k, b in sorted(found)]


# The lattice: chunks, whole-span features, transitions.

_CHUNK = re.compile(r"""["'`,;=:|&<>]*[^\s"'`,;=:|&<>]+["'`,;=:|&<>]*|["'`,;=:|&<>]+""")
# Words that announce personal data, by what they announce.
CUES = {
    "secret": "password passwd pwd secret token key apikey api_key auth bearer credential credentials access".split(),
    "iban": "iban account konto cuenta compte".split(),
    "ssn": "ssn social sozialversicherung insurance security".split(),
    "phone": "phone tel telefon telephone mobile call fax teléfono téléphone".split(),
    "card": "card visa mastercard credit karte tarjeta carte".split(),
    "email": "email mail e-mail contact correo".split(),
    "ip": "ip host server address".split(),
}
_CUE = {w: k for k, words in CUES.items() for w in words}
_EDGE = "\"'`()[]{}<>,;:!?.&|»«“”"
_SHAPES = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_RUN = re.compile(r"(.)\1+")
_NAME = re.compile(r"[a-z_-]+(?=\s*[=:])|[a-z_-]+", re.I)
_ASSIGNED = re.compile(r"""["'`]?\s*[=:]""")
_SPLIT = re.compile(r"""[=:\s"'`]+""")
_PREFIX = re.compile(r"AKIA|ASIA|AIza|sk-|pk-|gh[pousr]_|glpat-|xox[a-z]-|eyJ")
_HUMP = re.compile(r"[a-z][A-Z]|[0-9][A-Za-z]|[A-Za-z][0-9]|[A-Z]{2}[a-z]")
_TOKEN = re.compile(r"[A-Za-z0-9_/+.-]+")
_WORDLIKE = re.compile(r"[^\W\d_]+")
#: What may be in an entity: a digit, an @, a word that announces a secret, a value of mixed letters, long capitals.
_HINT = re.compile(r"[0-9@]|[a-z][A-Z]|[A-Z]{12}|(?<![A-Za-z])(?:sk-|pk-|gh[pousr]_|glpat-|xox[a-z]-|(?i:" + "|".join(sorted(CUES["secret"], key=len, reverse=True)) + r")(?![A-Za-z]))")


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation around it; an opening bracket of a number stays with its pair."""
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    return start, end


def _cue_of(word: str) -> str:
    """What a name announces, by itself or by its last part (db_password)."""
    word = word.lower().strip("_-")
    return _CUE.get(word) or _CUE.get(re.split("[_-]", word)[-1], "none")


def span_features(text: str, chunks: list[tuple[int, int]], i: int, j: int) -> tuple[str, ...]:
    """Features of chunks i..j-1 as one entity; none if they can't be one."""
    start, end = _trim(text, chunks[i][0], chunks[j - 1][1])
    body = text[start:end]
    n_digits = sum(map(len, _DIGITS.findall(body)))
    if len(body) < 5:
        return ()
    before = text[max(0, start - 24) : start].lower().split()
    cue = next((_CUE[w] for w in reversed([x.strip(_EDGE + "=") for x in before[-2:]]) if w in _CUE), "none")
    own = _NAME.match(body)
    name = _cue_of(own[0]) if own and own.end() < len(body) else "none"
    value = _SPLIT.split(body.rstrip("="))[-1]
    humps = len(_HUMP.findall(value)) if len(value) >= 8 else 0
    prefix = _PREFIX.match(value)
    # all but secrets have an @ or digits; a secret is announced, or its value isn't a word
    if n_digits < 3 and "@" not in body and cue != "secret" and name != "secret" and not prefix and not humps and not (len(value) >= 12 and value.isupper()):
        return ()
    shape = _RUN.sub(r"\1", body.translate(_SHAPES))
    classes = "".join(sorted(set(body.translate(_SHAPES)) - {"9", "a", "A"}))
    letters = len(body) - n_digits
    mixed = len(value) >= 12 and bool(_TOKEN.fullmatch(value)) and humps >= 3
    features = [
        "bias",
        f"chunks={j - i}",
        f"shape={shape[:14]}",
        f"digits={min(n_digits, 20)}",
        f"signs={classes}",
        f"cue={cue}",
        f"name={name}",
        f"random={mixed}:{len(set(value)) >= 8}",
        f"letters={'some' if letters > len(classes) else 'none'}",
        f"value={min(len(value) // 4, 10)}:{'x' if re.fullmatch('[0-9a-f]+', value) else 'X' if re.fullmatch('[0-9A-Z]+', value) else '-'}",
    ]
    assigned = bool(own and _ASSIGNED.match(body, own.end()))
    if name != "none":
        features.append(f"assigned={assigned}")
    plain = bool(_WORDLIKE.fullmatch(value)) and (value[1:].islower() or value.isupper() and len(value) < 12)
    if n_digits < 3 and "@" not in body:
        announced = "own" if name == "secret" and assigned else "before" if cue == "secret" and text[max(0, start - 8) : start].rstrip(" \"'`").endswith(("=", ":")) else "loose" if cue == "secret" else "none"
        features += [f"few={announced}:{plain}", f"few={announced}:{j - i}", f"words={min(len(body.split()), 4)}:{plain}", f"equals={'=' in body}:{plain}", f"pieces={len([x for x in _SPLIT.split(body) if x]) - (announced == 'own')}"]
    features.append(f"humps={min(humps, 5)}:{min(len(value) // 8, 4)}")
    if prefix:
        features.append(f"prefix={len(value) >= 16}")
        features.append(f"prefix:{j - i}:{name}")
    if digit_groups := re.fullmatch(r"\(?[0-9]+\)?(?:[ .-][0-9]+)+", body):
        features.append(f"groups={'-'.join(str(min(len(g), 5)) for g in _DIGITS.findall(digit_groups[0]))[:15]}")
        features.append(f"pairs={len(_DIGITS.findall(body)) >= 4 and 9 <= n_digits <= 11 and body[0] == '0'}")
    if 13 <= n_digits <= 19 and not letters - body.count(" ") - body.count("-"):
        features.append(f"luhn={luhn(''.join(_DIGITS.findall(body)))}")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{1,4}){3,8}", body):
        features.append("shape of iban")
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", body):
        features.append("shape of ssn")
    return tuple(features)


def lattice(text: str, chunks: list[tuple[int, int]]) -> list[list[tuple[int, tuple[str, ...]]]]:
    """For each end j the segments (i, features) that may end there, entities only."""
    out: list[list[tuple[int, tuple[str, ...]]]] = [[] for _ in range(len(chunks) + 1)]
    for j in range(1, len(chunks) + 1):
        for i in range(max(0, j - MAX_CHUNKS), j):
            if features := span_features(text, chunks, i, j):
                out[j].append((i, features))
    return out


#: By type: weights of features and of the type that comes next.
Weights = dict[str, dict[str, float]]


def _fits(kind: str, features: tuple[str, ...]) -> bool:
    """A card number passes the check of its last digit; anything may be of the other types."""
    return kind != "card" or "luhn=True" in features


def _score(weights: dict[str, float], features: tuple[str, ...]) -> float:
    return sum([weights[f] for f in features if f in weights])


def viterbi(weights: Weights, segments: list[list[tuple[int, tuple[str, ...]]]]) -> list[tuple[int, int, str]]:
    """The entities (i, j, type) of the best segmentation."""
    n = len(segments) - 1
    kinds = (OUT, *TYPES)
    step = {(a, b): weights[a].get(b, 0.0) for a in kinds for b in kinds}
    best = [{OUT: (0.0, None)}]
    for j in range(1, n + 1):
        here: dict[str, tuple] = {}

        def offer(i: int, kind: str, gain: float) -> None:
            for last, (value, _) in best[i].items():
                total = value + gain + step[last, kind]
                if kind not in here or total > here[kind][0]:
                    here[kind] = (total, (i, last))

        offer(j - 1, OUT, 0.0)
        for i, features in segments[j]:
            for kind in TYPES:
                if _fits(kind, features):
                    offer(i, kind, _score(weights[kind], features))
        best.append(here)
    found, j, kind = [], n, max(best[n], key=lambda k: best[n][k][0])
    while j:
        i, last = best[j][kind][1]
        if kind != OUT:
            found.append((i, j, kind))
        j, kind = i, last
    return found[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expectations(weights: Weights, segments: list[list[tuple[int, tuple[str, ...]]]]) -> dict:
    """Expected counts of all features and transitions under the model, by forward-backward sums."""
    n = len(segments) - 1
    kinds = (OUT, *TYPES)
    step = {(a, b): weights[a].get(b, 0.0) for a in kinds for b in kinds}
    arcs = [[] for _ in range(n + 1)]  # by end: (start, kind, score, features)
    for j in range(1, n + 1):
        arcs[j] = [(j - 1, OUT, 0.0, ())] + [(i, k, _score(weights[k], f), f) for i, f in segments[j] for k in TYPES if _fits(k, f)]
    ahead: list[dict[str, float]] = [{OUT: 0.0}] + [{} for _ in range(n)]
    into: list[dict[str, float]] = [{} for _ in range(n + 1)]  # sums over what may come before a kind
    for j in range(1, n + 1):
        into[j - 1] = {k: _log_sum([v + step[last, k] for last, v in ahead[j - 1].items()]) for k in kinds}
        sums: dict[str, list[float]] = {}
        for i, kind, score, _ in arcs[j]:
            sums.setdefault(kind, []).append(into[i][kind] + score)
        ahead[j] = {k: _log_sum(v) for k, v in sums.items()}
    whole = _log_sum(list(ahead[n].values()))
    starts: list[list] = [[] for _ in range(n + 1)]  # arcs by start
    for j in range(1, n + 1):
        for i, kind, score, features in arcs[j]:
            starts[i].append((j, kind, score, features))
    back: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(ahead[n], 0.0)]
    expected: dict = {}
    for i in range(n - 1, -1, -1):
        sums = {}
        for j, kind, score, features in starts[i]:
            rest = score + back[j][kind]
            sums.setdefault(kind, []).append(rest)
            p = math.exp(into[i][kind] + rest - whole)
            if p > 1e-6:
                for f in features:
                    expected[kind, f] = expected.get((kind, f), 0.0) + p
        after = {k: _log_sum(v) for k, v in sums.items()}
        for last, value in ahead[i].items():
            back[i][last] = _log_sum([step[last, k] + v for k, v in after.items()])
            for k, v in after.items():
                p = math.exp(value + step[last, k] + v - whole)
                if p > 1e-6:
                    expected[last, k] = expected.get((last, k), 0.0) + p
    return expected


# Training sentences are generated: words, and entities or what resembles them.


def _entity(rnd: random.Random, kind: str) -> str:
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    if kind == "email":
        return f"{pick(lower, rnd.randint(2, 9))}{rnd.choice(['', '.', '_'])}{digits(rnd.randint(0, 3))}@{pick(lower, rnd.randint(3, 8))}{rnd.choice(['', '1'])}.{rnd.choice(['com', 'org', 'co.uk', 'example.net'])}"
    if kind == "ip":
        return ".".join(str(rnd.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = rnd.choice("3456") + digits(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        number = body + last
        return number if rnd.random() < 0.5 else rnd.choice([" ", "-"]).join(number[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        if rnd.random() < 0.25:
            return rnd.choice([" ", " ", ".", "-"]).join(["0" + digits(1), *[digits(2) for _ in range(4)]])
        return rnd.choice([f"+{rnd.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{rnd.randint(1, 99)} {digits(3)} {digits(7)}"])
    if kind == "secret":
        name = rnd.choice(CUES["secret"][:8])
        value = pick("0123456789abcdef", rnd.choice([16, 18, 32, 40]))
        if rnd.random() < 0.5:  # few digits or none, or long
            quote = rnd.choice(["", '"'])
            word = pick(lower, rnd.randint(5, 12))
            password = rnd.choice([word, word, word.title() + rnd.choice("!?#$%") + pick(lower, 3), word + digits(rnd.randint(1, 2)), pick(upper + lower, rnd.randint(8, 24)), word + "-" + pick(lower, 4), "".join(rnd.choice(lower + upper + "!#$%*+") for _ in range(rnd.randint(8, 16))) + "x"])
            web = lambda n: pick(upper + lower + "0123456789_-", n - 1) + "Q"
            return rnd.choice([
                f"{rnd.choice(['', 'db_', 'my-'])}{name}={quote}{password}{quote}",
                f"{rnd.choice(CUES['secret'][:4])}: {password}" if not password.isalpha() or not password.islower() else f"{name}={password}",
                f"AKIA{pick(upper + rnd.choice(['', '234567', '0123456789']), 16)}",
                f"{rnd.choice(['sk-', 'ghp_', 'pk-', 'glpat-'])}{pick(upper + lower, rnd.choice([20, 32, 36]))}",
                f"eyJ{web(rnd.randint(15, 60))}.eyJ{web(rnd.randint(30, 200))}.{web(43)}",
                pick(upper + lower + "234567", rnd.choice([24, 32, 40])),
            ])
        return rnd.choice([f"AKIA{pick(upper + '0123456789', 15)}7", f"{name}={value}", f'{name} = "{value}"', f"{name}: {value}", f"sk-{pick(upper + lower + '0123456789', 31)}4", f"ghp_{pick(upper + lower + '0123456789', 34)}9"])
    if kind == "iban":
        number = pick(upper, 2) + digits(2) + pick(rnd.choice(["0123456789", "0123456789", "0123456789" + upper]), rnd.randint(11, 28))
        return number if rnd.random() < 0.5 else " ".join(number[i : i + 4] for i in range(0, len(number), 4))
    return f"{digits(3)}-{digits(2)}-{digits(4)}"


def _plain(rnd: random.Random) -> str:
    """What has digits, cues or mixed letters and is no personal data."""
    d = lambda a, b: rnd.randint(a, b)
    if rnd.random() < 0.1:  # as long as a card, with a wrong check digit
        number = str(d(10**15, 10**16 - 2))
        return number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10)
    if rnd.random() < 0.4:
        word = lambda: rnd.choice("main value words reading lights minor house green answer matter found people quick river stone public given things".split())
        hump = lambda: "".join(w.title() for w in (word(), word()))
        cue = rnd.choice(CUES["secret"])
        return rnd.choice([f"{cue} {word()} {word()}", f"{cue.title()}: {word()} {word()} {word()}", f"the {cue}, {word()} and {word()}", f"{cue} to {word()}", f"{word()} {cue}.", f"{cue} {word()}", hump(), word() + hump(), word() + hump() + hump(), word()[:3] + hump() + "By" + hump()[:2], f"{hump()}.{word()}", "".join(word() for _ in range(2)).upper(), f"{word()}={d(1, 99)}", f"{word()}: {word()}", f"{word().upper()} {word().upper()}", f"{word()}-{word()}-{word()}", f"https://{word()}.org/{word()}/{word()}", f"{cue}s {word()}", f"{d(1, 31)} {d(1, 12)} {d(10, 99)}", f"{d(1, 9)} {d(1, 9)} {d(10, 99)} {d(10, 99)}", f"{word()}, {d(1, 9)}, {d(1, 99)}, {d(1, 99)}, {d(1, 99)}", f"{word()}{d(1, 99)}"])
    return rnd.choice([f"{d(1900, 2100)}", f"{d(1, 9)}.{d(0, 9)}.", f"{d(1900, 2099)}-{d(1, 12):02}-{d(1, 28):02}", f"{d(1, 999)},{d(0, 999):03}", f"{d(1, 28)}.{d(1, 12)}.{d(1990, 2030)}", f"{d(10000, 9999999)}", f"{d(1900, 2000)}-{d(2001, 2099)}", f"{d(1, 24)}:{d(0, 59):02}:{d(0, 59):02}", f"({d(1000, 2100)})", f"v{d(1, 9)}.{d(0, 20)}.{d(0, 200)}", f"{d(100, 999)}.{d(1000, 9999)}", f"key {d(1, 9999)}", f"ISBN {d(10**12, 10**13 - 1)}", f"+{d(1, 9999)}", f"{d(10**13, 10**14)}km", f"abc{d(100, 999)}", f"{d(1, 99)}-{d(100, 999)}"])


def training_set(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, list[Span]]]:
    rnd = random.Random(seed)
    words = ["the", "of", "on", "Reading", "was", "over", "und", "der", "que", "la", "for", "with", "list,", "end.", "token", "call", "key", "account"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(2, 4)):
            text += " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) + " "
            if rnd.random() < 0.65:
                kind = rnd.choice(TYPES)
                if rnd.random() < 0.4 and kind in CUES:
                    text += rnd.choice(CUES[kind]) + rnd.choice([" ", ": "])
                body = _entity(rnd, kind)
                opened = rnd.choice(["", "", "", "("]) if not body.startswith("(") else ""
                spans.append((kind, len(text) + len(opened), len(text) + len(opened) + len(body.rstrip('"'))))
                text += opened + body + (")" if opened else rnd.choice(["", "", ".", ","])) + " "
            else:
                text += _plain(rnd) + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def fit() -> Weights:
    """Weights of the model, by stochastic gradient ascent with a small quadratic penalty."""
    prepared = []
    for text, spans in training_set():
        chunks = [m.span() for m in _CHUNK.finditer(text)]
        segments = lattice(text, chunks)
        gold: dict = {}
        last, j = OUT, 0
        wanted = {}
        for kind, a, b in spans:
            i = next(k for k, c in enumerate(chunks) if c[1] > a)
            e = next(k for k, c in enumerate(chunks) if c[1] >= b) + 1
            wanted[i] = (e, kind)
        while j < len(chunks):
            end, kind = wanted.get(j, (j + 1, OUT))
            features = next((f for i, f in segments[end] if i == j), ()) if kind != OUT else ()
            if kind != OUT and not features:
                kind, end = OUT, j + 1
            gold[last, kind] = gold.get((last, kind), 0.0) + 1
            for f in features:
                gold[kind, f] = gold.get((kind, f), 0.0) + 1
            last, j = kind, end
        prepared.append((segments, gold))
    weights: Weights = {k: {} for k in (OUT, *TYPES)}
    for epoch in range(EPOCHS):
        rate = 0.35 / (1 + 0.3 * epoch)
        for segments, gold in prepared:
            expected = expectations(weights, segments)
            for key in gold.keys() | expected.keys():
                of, name = key
                old = weights[of].get(name, 0.0)
                weights[of][name] = old + rate * (gold.get(key, 0.0) - expected.get(key, 0.0) - 0.002 * old)
    return {k: {f: round(v, 4) for f, v in of.items() if abs(v) > 1e-3} for k, of in weights.items()}


_WHITE = re.compile(r"\s|\Z")
_NUMBERS = re.compile(r"[0-9](?:\W{0,3}[0-9]){2}|[0-9]{0,2}[A-Za-z_]")


def _number_near(text: str, at: int) -> bool:
    """Whether the first digit of a chunk has two more close by, signs or a space between, or letters beside it."""
    return bool(_NUMBERS.match(text, at)) or at > 0 and (text[at - 1].isalpha() or text[at - 1] in "-_/+.")


def model_spans(text: str, weights: Weights) -> list[Span]:
    """Entities that the model finds, in order."""
    regions: list[list[int]] = []  # [start, end): around each hint
    at = 0
    while m := _HINT.search(text, at):
        at = m.end()
        if m.end() - m.start() == 1 and m[0] != "@" and not _number_near(text, m.start()):
            continue
        a, e = m.span()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        at = e = _WHITE.search(text, e).start()
        low, high = max(0, a - 40), min(len(text), e + 40)
        if regions and low <= regions[-1][1]:
            regions[-1][1] = high
        else:
            regions.append([low, high])
    found = []
    for low, high in regions:
        while low > 0 and not text[low - 1].isspace():
            low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        chunks = [m.span() for m in _CHUNK.finditer(text, low, high)]
        for i, j, kind in viterbi(weights, lattice(text, chunks)):
            found.append((kind, *value_of(text, kind, *_trim(text, chunks[i][0], chunks[j - 1][1]))))
    return found


_NAMED = re.compile(r"""["'`]?[A-Za-z][\w-]*["'`]?\s*[=:]\s*["'`]*""")


def value_of(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """The span of a secret without the name it is given to and its opening quote."""
    named = _NAMED.match(text, start, end) if kind == "secret" else None
    return (named.end(), end) if named and named.end() < end else (start, end)


def all_spans(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by start, then kind in the order of TYPES."""
    base = base_spans(text)
    spans = list(base)
    taken = sorted((a, b) for _, a, b in base)
    reach = 0
    at = 0
    for kind, a, b in model_spans(text, weights):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= reach and not any(x < b and y > a for x, y in taken[max(0, at - 1) : at + 4]):
            spans.append((kind, a, b))
            reach = b
    return base, sorted(spans, key=lambda s: (s[1], TYPES.index(s[0])))


def _mapped(docs: DataFrame, keep: list[str], text: str, make: Callable, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """keep and new fields, made from each text."""
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("__t"))
    shared = docs.sparkSession.sparkContext.broadcast(fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = list(zip(*[make(v.as_py(), weights) for v in part.column(len(keep))]))
                made = [pa.array(c, t) for c, (_, _, t) in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*names, *[n for n, _, _ in fields]])

    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + [f"`{n}` {t}" for n, t, _ in fields]
    return rows.mapInArrow(run, ", ".join(kinds)).select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *[F.col(f"`{n}`") for n, _, _ in fields])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id_col, base_spans and spans, both array<struct<kind, start, end>>."""

    def make(value: str | None, weights: Weights) -> tuple:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        base, spans = all_spans(value or "", weights)
        return as_rows(base), as_rows(spans)

    kind = "array<struct<kind:string,start:int,end:int>>"
    return _mapped(docs, [id_col], text, make, [("base_spans", kind, _SPAN), ("spans", kind, _SPAN)])


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in square brackets; overlapping spans by the first."""

    def make(value: str | None, weights: Weights) -> tuple:
        if value is None:
            return (None,)
        out, at = [], 0
        for kind, a, b in all_spans(value, weights)[1]:
            if b <= at:
                continue
            if a >= at:
                out += [value[at:a], f"[{kind.upper()}]"]
            at = b
        return ("".join(out) + value[at:],)

    name = "new_" + "_".join(docs.columns)  # no column's name
    changed = _mapped(docs, docs.columns, text, make, [(name, "string", pa.string())])
    new = F.col(f"`{name}`")
    of = {text: new.alias(text), length: F.coalesce(F.length(new), F.lit(0)).cast("long").alias(length)}
    return changed.select(*[of.get(c, F.col(f"`{c}`")) for c in docs.columns])
