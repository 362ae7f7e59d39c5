"""Secret scan: patterns, and a battery of randomness tests for strings no pattern names.

Base spans come from three patterns (assigned values, access keys, long hex strings).
The battery adds spans of kind "random":

1. Candidates are runs of 20 or more of ``A-Z a-z 0-9 + / _ -``. Where punctuation sets off
   plain words, the run is cut at them and its pieces of that length are candidates; a run
   without such a piece is one as a whole if it has a single plain word at most. The smallest of a few alphabets that holds a candidate is its
   inferred encoding (decimal, hex, base 32, base 36, base 62, base 64); characters become values.
2. Three tests ask whether the values look uniform and independent: chi-squared over equal
   cells of the alphabet (as many as the length allows), the number of runs above and below
   the middle, and the serial correlation of neighbours. Fisher's method combines them; a run
   that fails the battery at ALPHA is not random. Random strings score alike in any order of
   the alphabet; values follow how common a character is in ordinary text, so that ordinary
   text fills the low cells only.
3. A short string fails rarely, random or not, so passing alone proves little. For each
   candidate a decoy of the same length, the characters of the alphabet among the letters and
   digits around it in its document (in the case of an alphabet of one case), is tested under
   the same encoding. The decoys of a stratum (encoding and length) show how
   ordinary text scores there: mean and spread of the root of Fisher's statistic, pulled
   towards those of all decoys where a stratum has few, and these towards a fixed null where there
   are few at all: strings of common words (WORDS) under the same encoding. So a corpus of bare keys,
   or of keys in a script without Latin words, has a null too. A candidate's p-value is the normal
   tail below its own score, and the Benjamini-Hochberg step over all candidates of the
   corpus at rate FDR decides.

Decoy moments and the histogram of p-values (bounded by strata and bins) are the only things
gathered; they come from all documents.

Cases: a NULL or empty text has no spans; rows are scanned alone and strata are sums, so
repeated rows and ties are counted as often as they occur; a NULL doc_id is kept; a table
without rows gives none; further columns are not looked at.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import column, map_rows, stored

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
ALPHA = 5e-3
FDR = 0.01
# Weight, in decoys, of all strata together in the moments of one, and of the fixed null in those.
PRIOR = 50
# What the fixed null is made of: common words and numbers; so many strings for a stratum.
WORDS = (
    "the of and to in that is was for it with as his on be at by had not are but from or have they which one you"
    " were all her she there would their we him been has when who will no more if out so what up said about than"
    " time year people way day man thing woman life child world school state family student group country problem"
    " hand part place case week company system program question work government number night point home water room"
    " der die und das nicht ein mit sich auf den ist auch werden haben dass eine Zeit Jahr Haus Welt Leben"
    " le les des est dans pour que une sur avec pas plus tout homme monde vie jour temps"
    " el los las por con para una como pero sus este mundo casa tiempo"
    " 1 2 3 10 12 15 20 25 100 250 1000 1998 2004 2011 2016 2020 2023 31 07 365 5000 60 24"
).split()
NULL_STRINGS = 200
BINS_PER_DECADE, MAX_DECADES = 20, 40

_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH)
_WORDS_NEAR = re.compile(r"[A-Za-z0-9]+")
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LETTERS = _UPPER + _LOWER
# Parts of a run between punctuation that are letters only.
_PARTS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]+(?![A-Za-z0-9])")
ENCODINGS = [
    ("hex", _DIGIT + "abcdef"),
    ("HEX", _DIGIT + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGIT + _LOWER),
    ("BASE36", _DIGIT + _UPPER),
    ("base62", _DIGIT + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
    ("base66", _UPPER + _LOWER + _DIGIT + "+/-_"),
    ("decimal", _DIGIT),
]
# From common to rare in ordinary text.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
_MIXED, _CAPITALS = _COMMON + _DIGIT + "-_/+" + _COMMON.upper(), _COMMON.upper() + _DIGIT
_VALUES = []
for _, _alphabet in ENCODINGS:
    _table = np.full(256, -1, np.int64)
    _order = _CAPITALS if set(_alphabet) <= set(_CAPITALS) else _MIXED
    _ranked = "".join(sorted(_alphabet, key=_order.index))
    _table[np.frombuffer(_ranked.encode(), np.uint8)] = np.arange(len(_alphabet))
    _VALUES.append(_table)
# Smallest first.
_SETS = sorted(((i, frozenset(a)) for i, (_, a) in enumerate(ENCODINGS)), key=lambda s: len(s[1]))
# What makes a decoy of the letters and digits near a run: other characters go.
_TO_ALPHABET = []
for _, _alphabet in ENCODINGS:
    _kept = {ord(c): c for c in _LETTERS + _DIGIT if c in _alphabet}
    if _kept.keys().isdisjoint(map(ord, _UPPER)):
        _kept |= {ord(c.upper()): c for c in _LOWER if c in _alphabet}
    if _kept.keys().isdisjoint(map(ord, _LOWER)):
        _kept |= {ord(c.lower()): c for c in _UPPER if c in _alphabet}
    _TO_ALPHABET.append({ord(c): _kept.get(ord(c)) for c in _LETTERS + _DIGIT})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    low = text.lower()
    spans = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                spans.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def encoding_of(run: str) -> int:
    """Index of the smallest alphabet that holds the run."""
    used = set(run)
    return next(i for i, s in _SETS if used <= s)


def pieces(run: str) -> list[tuple[int, int]]:
    """What is to be tested of a run: the pieces between plain words; the whole, if there is
    none and at most one word."""
    out, words, last = [], [], 0
    if not set(run).isdisjoint("+/_-"):
        words = [
            m.span()
            for m in _PARTS.finditer(run)
            if 2 < len(m.group()) < MIN_LENGTH and (m.group().islower() or m.group().isupper() or m.group().istitle())
        ]
        for a, b in [*words, (len(run) + 1, 0)] if words else ():
            # The punctuation beside a word goes with it.
            if a - 1 - last >= MIN_LENGTH:
                out.append((last, a - 1))
            last = b + 1
    return out or ([(0, len(run))] if len(words) < 2 else [])


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, encoding, decoy) of the runs to be tested."""
    out = []
    for m in _RUN.finditer(text):
        for a, b in pieces(m.group()):
            start, end = m.start() + a, m.start() + b
            encoding = encoding_of(text[start:end])
            out.append((start, end, encoding, decoy(text, start, end, encoding)))
    return out


def decoy(text: str, start: int, end: int, encoding: int) -> str:
    """As many characters of the alphabet as the run has, from the words before it, then after it."""
    n = end - start
    near = ""
    for reach in (4 * n, 16 * n):
        words = [w for w in _WORDS_NEAR.findall(text[max(0, start - reach) : start]) if len(w) < MIN_LENGTH]
        words += [w for w in _WORDS_NEAR.findall(text[end : end + reach]) if len(w) < MIN_LENGTH]
        near = "".join(words).translate(_TO_ALPHABET[encoding])
        if len(near) >= n:
            break
    return near[:n] if len(near) >= n else ""


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """-ln of the two-sided normal tail, by its asymptote where it would vanish."""
    z = np.abs(z)
    near = np.array([math.erfc(min(x, 25.0) / math.sqrt(2)) for x in z.tolist()])
    far = z * z / 2 + np.log(np.maximum(z, 1)) + 0.5 * math.log(math.pi / 2)
    return np.where(z < 25, -np.log(np.maximum(near, 1e-300)), far)


def battery(strings: list[str], encodings: list[int]) -> np.ndarray:
    """Fisher's statistic (chi-squared with 6 degrees of freedom if random) of each string."""
    if not strings:
        return np.empty(0)
    n = np.array([len(s) for s in strings])
    size = np.array([len(ENCODINGS[e][1]) for e in encodings])
    stop = np.cumsum(n)
    start = stop - n
    who = np.repeat(np.arange(len(n)), n)
    data = np.frombuffer("".join(strings).encode("latin-1", "replace"), np.uint8)
    value = np.stack(_VALUES)[np.asarray(encodings)[who], data]
    # Chi-squared over m equal cells, five or more expected in each; Wilson-Hilferty.
    m = np.clip(n // 5, 2, np.minimum(size, 16))
    cell = value * m[who] // size[who]
    counts = np.zeros((len(n), 16))
    np.add.at(counts, (who, cell), 1)
    # Cells differ by a symbol where the alphabet does not divide.
    edges = -(-np.arange(17)[None, :] * size[:, None] // m[:, None])
    share = np.diff(np.minimum(edges, size[:, None]), axis=1) / size[:, None]
    expected = n[:, None] * share
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(share > 0, (counts - expected) ** 2 / expected, 0).sum(1)
    df = m - 1
    z = (np.cbrt(chi / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    uniform = _upper_tail(np.maximum(z, 0))
    # Runs above and below the middle: changes are binomial with chance 2 p q.
    high = value * 2 >= size[who]
    p = np.ceil(size / 2) / size
    chance = 2 * p * (1 - p)
    change = np.zeros(len(data))
    change[1:] = high[1:] != high[:-1]
    change[start] = 0
    changes = np.add.reduceat(change, start)
    runs = _upper_tail((changes - (n - 1) * chance) / np.sqrt((n - 1) * chance * (1 - chance)))
    # Serial correlation with the known mean and variance of the alphabet.
    centred = value - (size[who] - 1) / 2
    product = np.zeros(len(data))
    product[1:] = centred[1:] * centred[:-1]
    product[start] = 0
    variance = (size.astype(float) ** 2 - 1) / 12
    serial = _upper_tail(np.add.reduceat(product, start) / (variance * np.sqrt(n - 1)))
    return 2 * (uniform + runs + serial)


def fisher_p(statistic: np.ndarray) -> np.ndarray:
    """Tail of chi-squared with 6 degrees of freedom."""
    h = statistic / 2
    return np.exp(-h) * (1 + h + h * h / 2)


_FOUND = (
    "base array<struct<start: bigint, kind: int, end: bigint>>,"
    " runs array<struct<start: bigint, end: bigint, stratum: int, score: double, random: boolean,"
    " decoy: double>>"
)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, runs): base spans and tested candidates of each row."""

    def scan(batch: pa.RecordBatch) -> list:
        texts = [t or "" for t in column(batch, "text")]
        base = [
            [{"start": s, "kind": k, "end": e} for s, k, e in base_spans(t)] for t in texts
        ]
        tested = [candidates(t) for t in texts]
        flat = [c for some in tested for c in some]
        scores = battery([t[a:b] for t, some in zip(texts, tested) for a, b, *_ in some], [c[2] for c in flat])
        paired = [i for i, c in enumerate(flat) if c[3]]
        others = np.full(len(flat), np.nan)
        others[paired] = battery([flat[i][3] for i in paired], [flat[i][2] for i in paired])
        random = fisher_p(scores) >= ALPHA
        rows = iter(
            {
                "start": a,
                "end": b,
                "stratum": stratum(e, b - a),
                "score": math.sqrt(s),
                "random": ok,
                "decoy": None if math.isnan(o) else math.sqrt(o),
            }
            for (a, b, e, _), s, ok, o in zip(flat, scores.tolist(), random.tolist(), others.tolist())
        )
        runs = [[next(rows) for _ in some] for some in tested]
        return [batch.column(batch.schema.get_field_index("doc_id")), base, runs]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, {_FOUND}", scan)


def stratum(encoding: int, length: int) -> int:
    """Encoding and length, in steps of a quarter octave up to 64 times MIN_LENGTH."""
    return encoding * 32 + min(24, int(4 * math.log2(length / MIN_LENGTH)))


@lru_cache(None)
def fixed_null(of: int) -> tuple[float, float]:
    """Mean and mean square of the scores of word strings of a stratum's encoding and length."""
    encoding, octave = divmod(of, 32)
    n, rng = int(MIN_LENGTH * 2 ** ((octave + 0.5) / 4)), random.Random(of)
    usable = [w for w in (word.translate(_TO_ALPHABET[encoding]) for word in WORDS) if w]
    strings = []
    for _ in range(NULL_STRINGS):
        text = ""
        while len(text) < n:
            word = rng.choice(usable)
            text += word.title().translate(_TO_ALPHABET[encoding]) if rng.random() < 0.08 else word
        strings.append(text[:n])
    scores = np.sqrt(battery(strings, [encoding] * NULL_STRINGS))
    return float(scores.mean()), float((scores**2).mean())


def null_moments(found: DataFrame) -> dict[int, tuple[float, float]]:
    """Mean and standard deviation of decoy scores for each stratum, pulled to the whole and that to
    the fixed null."""
    sums = (
        found.select(F.explode("runs").alias("r"))
        .groupBy("r.stratum")
        .agg(
            F.count("r.decoy").alias("n"),
            F.coalesce(F.sum("r.decoy"), F.lit(0.0)).alias("s"),
            F.coalesce(F.sum(F.col("r.decoy") * F.col("r.decoy")), F.lit(0.0)).alias("q"),
        )
        .collect()
    )  # at most 32 strata for each encoding
    n, s, q = (sum(r[c] for r in sums) for c in ("n", "s", "q"))
    out = {}
    for r in sums:
        mean, square = ((total + PRIOR * fixed) / (n + PRIOR) for total, fixed in zip((s, q), fixed_null(r.stratum)))
        m = (r.s + PRIOR * mean) / (r.n + PRIOR)
        spread = (r.q + PRIOR * square) / (r.n + PRIOR) - m * m
        out[r.stratum] = (m, max(math.sqrt(max(spread, 0)), 0.25))
    return out


def rejection_bin(counts: dict[int, int]) -> int | None:
    """The smallest bin of -log10 p whose candidates Benjamini and Hochberg reject; None for no
    bin. A bin stands for its largest p-value."""
    total, above, best = sum(counts.values()), 0, None
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if 10 ** (-b / BINS_PER_DECADE) <= FDR * above / total:
            best = b
    return best


def _bin(moments: dict[int, tuple[float, float]]):
    """Column: the bin of a candidate's p-value, -1 where there is no null."""
    normal, top = NormalDist(), BINS_PER_DECADE * MAX_DECADES
    limits = {}
    for s, (mean, sd) in moments.items():
        # Score below which p is at most 10^(-b / BINS_PER_DECADE), for each bin.
        limits[s] = [mean + sd * normal.inv_cdf(10 ** (-b / BINS_PER_DECADE)) if b else math.inf for b in range(min(top, 300))]
    pairs = [x for s, v in limits.items() for x in (F.lit(s), F.array(*map(F.lit, v)))]
    if not pairs:
        return lambda r: F.lit(-1)
    table = F.create_map(*pairs)
    return lambda r: F.size(F.filter(F.element_at(table, r["stratum"]), lambda x: r["score"] <= x)) - 1


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and random: arrays of (start, kind, end); kind indexes KINDS."""
    found = stored(scanned(docs), "secret-candidates")
    place = _bin(null_moments(found))
    tested = found.withColumn(
        "runs", F.transform("runs", lambda r: F.struct(*[r[c].alias(c) for c in ("start", "end", "random")], place(r).alias("bin")))
    )
    counts = {
        r.bin: r.n
        for r in tested.select(F.explode("runs").alias("r"))
        .groupBy("r.bin")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    least = rejection_bin(counts)
    chosen = F.filter("runs", lambda r: r["random"] & (r["bin"] >= (10**6 if least is None else least)))
    # A run that a base span already covers, or overlaps, adds nothing.
    new = F.filter(
        chosen,
        lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])),
    )
    spans = F.transform(new, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return tested.select("doc_id", "base", spans.alias("random"))


def secret_query(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.concat_ws(
        ",",
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(
                ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
    )
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "random")).alias("spans"),
    )
