"""Secret scans: three base patterns, and values in credential contexts whose guess cost is high.

The guess cost of a value is the least number of guesses, as a power of ten, over all its segmentations into dictionary words (also with letters
replaced by look-alikes), dates and years, repeats, keyboard walks and brute-force spans; dynamic programming finds it. The cost alone
decides: a value of SHORTEST or more characters, of whatever kinds, whose cost is at least GUESSES is a secret that a pattern of fixed
shape would miss.

The ranked words are COMMON, then the words of public BPE vocabularies in the order of their merges, taken in turn, without repeats: lower-case
alphabetic entries, whole words of LEAST_WHOLE or more letters of a file whose words have an end, entries of LEAST_PART or more letters of a file of
ranked pieces. The files' paths are parameters; the driver reads them and broadcasts the ranks, whose number the vocabularies bound.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import zip_longest
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, vocabulary

KINDS = ("assign", "access", "hex", "guess")
#: Least cost of a secret as a power of ten, and least length of its value.
GUESSES, SHORTEST = 11.0, 8
#: Segments are at most SPAN long, or the whole of a repeat, sequence or keyboard walk. A longer value is costed only as far as every continuation costs enough.
SPAN = 32
#: Characters of a longer value that are costed first.
FIRST = 256
#: Least letters of the vocabularies' words.
LEAST_WHOLE, LEAST_PART = 3, 4
#: The vocabularies that the words are taken from if no others are named.
VOCABULARIES = ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|(?:api|auth|access|private|secret)[_-]?key)[\"']?\x20*[:=]\x20*[\"']?([^\s\"'<>]{8,})", re.IGNORECASE | re.ASCII)
_HINTS = ("pass", "secret", "token", "key", "pwd", "credential", "bearer")

#: Frequent words of passwords and configuration files, the most frequent first.
COMMON = """password qwerty admin welcome letmein login monkey dragon master sunshine princess football baseball shadow superman michael
hello charlie freedom whatever secret test guest root user changeme default example sample demo temp summer winter spring autumn
love hunter killer soccer hockey ranger buster thomas jordan robert daniel george andrew ginger pepper cookie cheese banana orange
qazwsx qazwsxedc zaq12wsx computer internet server service database system network access private public token value string null none true false todo
your here my the key pass word name mail local host prod stage develop redacted placeholder insert enter
passwort kennwort geheim geheimnis contraseña clave secreto secreta motdepasse secrète senha segredo segreto parola wachtwoord hasło
heslo salasana lösenord adgangskode şifre пароль секрет benutzer benutzername schlüssel zugang daten datenbank verbindung anmeldung
usuario utilisateur identifiant utente usuário gebruiker""".split()
LOOKS = str.maketrans("0134578@$!", "oieastbasi")
#: The rows of a keyboard, and how far each is shifted to the right of the one above the first.
ROWS, SHIFTS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"), (0.0, 1.5, 1.75, 2.25)
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d)\Z")
YEAR = re.compile(r"(?:19|20)\d\d\Z")
_PLACE = {c: (x + shift, y) for y, (row, shift) in enumerate(zip(ROWS, SHIFTS, strict=True)) for x, c in enumerate(row)}
KEYS = len(_PLACE)


class Ranks(dict):
    """Words to ranks, from 1."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((w, i + 1) for i, w in enumerate(dict.fromkeys(words)))
        self.longest = max(map(len, self), default=0)

    def __reduce__(self) -> tuple:
        return Ranks, (list(self),)


@lru_cache(4)
def ranks(paths: tuple[str, ...] = ()) -> Ranks:
    """The rank of each word, from 1; the vocabularies are VOCABULARIES if no paths are given."""
    lists = []
    for path in paths or tuple(map(vocabulary, VOCABULARIES)):
        if path.endswith(".json"):
            model = json.loads(Path(path).read_text())["model"]
            end = model.get("end_of_word_suffix") or ""
            names = sorted(model["vocab"], key=model["vocab"].get)
            lists.append([w for n in names if n.endswith(end) and len(w := n.removesuffix(end)) >= LEAST_WHOLE])
        else:
            ranked = (line.split() for line in Path(path).read_bytes().splitlines())
            names = [base64.b64decode(x).decode(errors="replace").strip() for x, _ in sorted(ranked, key=lambda x: int(x[1]))]
            lists.append([w for w in names if len(w) >= LEAST_PART])
    words = [w for turn in zip_longest(*lists) for w in turn if w and w.isalpha() and w == w.lower()]
    return Ranks(COMMON + words)


def step_of(a: str, b: str) -> tuple[int, int] | None:
    """The direction from a key to a neighbouring one; None if they aren't neighbours."""
    if a not in _PLACE or b not in _PLACE:
        return None
    (x, y), (u, v) = _PLACE[a], _PLACE[b]
    if (y == v and abs(u - x) == 1) or (abs(v - y) == 1 and abs(u - x) < 1):
        return (u > x) - (u < x), v - y
    return None


class Runs:
    """Of each end in a value, the start of the longest walk, sequence and repeats that end there, and the turns of walks up to it."""

    UNITS = 8

    def __init__(self, low: str) -> None:
        n = len(low)
        self.walk, self.turns, self.line = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self.repeat = [[0] * (n + 1) for _ in range(self.UNITS + 1)]
        way, gap = None, 0
        for e in range(1, n + 1):
            step = step_of(low[e - 2], low[e - 1]) if e > 1 else None
            self.walk[e] = self.walk[e - 1] if step else e - 1
            self.turns[e] = self.turns[e - 1] + (step is not None and step != way)
            way = step
            by = ord(low[e - 1]) - ord(low[e - 2]) if e > 1 and low[e - 1].isalnum() and low[e - 2].isalnum() else 0
            self.line[e] = e - 1 if abs(by) != 1 else self.line[e - 1] if by == gap else e - 2
            gap = by
            for unit in range(1, self.UNITS + 1):
                self.repeat[unit][e] = self.repeat[unit][e - 1] if e > unit and low[e - 1] == low[e - 1 - unit] else max(0, e - unit)

    def whole(self, e: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Of those longer than SPAN that end at e: starts of walks and sequences, and (start, unit) of repeats."""
        lines = [s for s in {self.walk[e], self.line[e]} if s < e - SPAN]
        found = ((e - (e - at[e]) // unit * unit, unit) for unit, at in enumerate(self.repeat) if unit)
        return lines, [(s, unit) for s, unit in found if s < e - SPAN]


def _brute(s: str) -> float:
    size = 10 * any(c.isdigit() for c in s) + 26 * any(c.islower() for c in s) + 26 * any(c.isupper() for c in s) + 33 * any(not c.isalnum() for c in s)
    return len(s) * math.log10(max(size, 2))


def _span_cost(value: str, low: str, s: int, e: int, runs: Runs, rank: Ranks) -> float:
    """The least cost of value[s:e] as one segment."""
    n, part, small = e - s, value[s:e], low[s:e]
    cost = _brute(part)
    if n < 3:
        return cost
    case = 0.0 if part == small else 0.3 if part in (small.upper(), small.capitalize()) else 0.3 * n
    if n <= rank.longest:
        for word, extra in ((small, 0.0), (small.translate(LOOKS), 0.6)):
            if word in rank:
                cost = min(cost, math.log10(rank[word] + 1) + extra + case)
    if n == 4 and YEAR.match(part):
        cost = min(cost, 2.0)
    if 6 <= n <= 10 and DATE.match(part):
        cost = min(cost, math.log10(365 * 120) + 0.5)
    if runs.walk[e] <= s:  # a first key, then for each straight stretch its direction and length
        cost = min(cost, math.log10(KEYS) + max(1, runs.turns[e] - runs.turns[s + 1]) * math.log10(2 * n) + case)
    if runs.line[e] <= s:
        cost = min(cost, math.log10(36 * 2 * n) + case)
    for unit in range(1, n // 2 + 1):
        if n % unit == 0 and (runs.repeat[unit][e] <= s if unit <= runs.UNITS else part == part[:unit] * (n // unit)):
            once = part[:unit]
            if part == once * (n // unit):
                cost = min(cost, _brute(once) + math.log10(n // unit))
            break
    return cost


def _least_costs(value: str, enough: float, rank: Ranks) -> tuple[float, bool]:
    """(the value's least cost, whether every longer value that begins so costs `enough` as well)"""
    low = value.lower() if len(value.lower()) == len(value) else value
    runs, best = Runs(low), [0.0]
    capitals = [0]
    for a, b in zip(value, low, strict=True):
        capitals.append(capitals[-1] + (a != b))
    for end in range(1, len(value) + 1):
        lines, repeats = runs.whole(end)
        far = [(s, _brute(value[s : s + unit]) + math.log10((end - s) // unit)) for s, unit in repeats if capitals[end] - capitals[s] in (0, end - s)]
        for s in lines:
            n, case = end - s, 0.3 * (capitals[end] - capitals[s])
            if runs.walk[end] <= s:
                far.append((s, math.log10(KEYS) + max(1, runs.turns[end] - runs.turns[s + 1]) * math.log10(2 * n) + case))
            if runs.line[end] <= s:
                far.append((s, math.log10(36 * 2 * n) + case))
        # Where a repeat is longer than two spans, going on with it costs less than log10(2) and no other segment does.
        near = () if any(s < end - 2 * SPAN for s, _ in repeats) and far else range(max(0, end - SPAN), end)
        costs = [best[s] + c + (0.3 if s else 0.0) for s, c in far] + [best[s] + _span_cost(value, low, s, end, runs, rank) + (0.3 if s else 0.0) for s in near]
        best.append(min(costs))
        if end > SPAN and not far and min(best[-SPAN:]) >= enough:
            return min(best[-SPAN:]), True
    return best[-1], False


def guess_cost(value: str, enough: float = math.inf, rank: Ranks | None = None) -> float:
    """The least cost over all segmentations; each further segment costs what guessing the number of segments does. Stops when every continuation reaches `enough`."""
    rank = ranks() if rank is None else rank
    if len(value) > FIRST:
        cost, settled = _least_costs(value[:FIRST], enough, rank)
        if settled:
            return cost
    return _least_costs(value, enough, rank)[0]


def find_secrets(text: str, rank: Ranks | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive. Base kinds are found as the patterns say; `guess` spans overlap none of them."""
    out: list[tuple[str, int, int]] = []
    low = text.lower() if any(text) else text
    hinted = any(h in low for h in _HINTS)
    if hinted:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if hinted:
        base = sorted(x[1:] for x in out)
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:)]}")
            s, e = m.start(1), m.start(1) + len(value)
            if len(value) < SHORTEST or any(a < e and s < b for a, b in base):
                continue
            if guess_cost(value, GUESSES, rank=rank) >= GUESSES:
                out.append(("guess", s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


RESULTS = ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "redacted")


def _scan(rank, redacted: bool) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:  # noqa: ANN001
    """A struct of RESULTS of each text; redacted is null where there is nothing to replace. rank: a broadcast of the words' ranks."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            rows = []
            for value in column:
                text = value.as_py() or ""
                spans = find_secrets(text, rank.value)
                n = [sum(x[0] == k for x in spans) for k in KINDS]
                rows.append((*n, hashlib.sha256(shown([x for x in spans if x[0] != "guess"]).encode()).hexdigest(), shown(spans), redact(text, spans) if spans and redacted else None))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(len(RESULTS))], RESULTS)

    return run


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, text: str = "text", redacted: bool = False, vocabularies: tuple[str, ...] = ()) -> DataFrame:
    """Find secrets in every whole text.

    Returns the columns `keep` (doc_id if None; one named as a result is left out), n_assign, n_access, n_hex, n_guess, base_sha256 (of the base
    spans as kind:start:end), spans (all spans likewise) and, if asked for, redacted: the text with the spans replaced. A null text has no
    spans (and stays null in redacted). Spans of equal start are ordered by kind, then end; repeated rows give repeated results; null ids
    keep their row. An empty table gives no rows. vocabularies: paths of the files that the ranked words come from. The text goes to Python once, and only
    what was found comes back."""
    results = RESULTS if redacted else RESULTS[:-1]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in results]
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "struct<n_assign:long,n_access:long,n_hex:long,n_guess:long,base_sha256:string,spans:string,redacted:string>"
    scan = F.arrow_udf(_scan(spark.sparkContext.broadcast(ranks(vocabularies)), redacted), schema).asNondeterministic()  # evaluated once a row
    whole = F.col(text).cast("string")
    found = docs.select(*keep, whole.alias("meridian_text"), scan(whole).alias("meridian_found"))
    shown_ = [F.coalesce("meridian_found.redacted", "meridian_text").alias(c) if c == "redacted" else F.col(f"meridian_found.{c}") for c in results]
    return found.select(*keep, *shown_)
