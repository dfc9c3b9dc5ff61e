"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 token characters or more that mixes letters and digits, or any value of 4 characters or more
that is assigned to a name: what stands between the quotes, or all up to white space where there are none (but for closing
signs at its end and a further assignment after a separator). Quoted values with blanks are looked at as a whole and
inside. The forest sees the candidate's length and character transitions, how much of it dictionary words cover, whether it is part
of a path, and the words beside it. It is trained from labelled findings (before, candidate, after, label); the default
ones are generated from a seed by `labelled_findings`.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridpulse.llm.common import slices
from gridpulse.llm.trees import Tree, parse, value

# Words that the scan knows.
DICTIONARY = (
    "about account address admin after and api app auth author backup bank base bearer book branch build cache case change city "
    "class client code color commit config connect content count country create credential customer data date default delete demo "
    "description device digest document domain download east email empty enter error event example false file filter first folder "
    "format from group hash header hello help home host image index info input insert item jwt key label language last left length "
    "level license like link list load local log login main master message model module month name native network new none north "
    "note null number object open option order output page param parent pass password path payment person phone picture place "
    "platform policy port private product profile project public query random read record region release remote report request "
    "reset resource response result right root sample schema secret section select send server service session set sign size "
    "source south staging start state static status stop storage street string style system table target task team template test "
    "text the this time title token true type update upload url user value version view web week west word work world write year your"
).split()
HINTS = ("token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential", "private", "signature")
HARMLESS = ("sha", "md5", "commit", "checksum", "digest", "hash", "uuid", "etag", "revision", "build", "version", "example", "sample", "placeholder", "order", "invoice", "phone", "mail", "file", "path", "image")
# End of fixed values.

_RUN = re.compile(r"[A-Za-z0-9_+/=.~@-]{16,}")
_SIGN = re.compile(r"[=:]\s{0,2}")
_QUOTED = {q: re.compile(rf"(?:\\.|[^{q}\\\n])*(?={q})") for q in "\"'"}
_BARE = re.compile(r"(?:(?![&;,|?][A-Za-z_][A-Za-z0-9_.-]{0,40}[=:])\S)+")
LEAST = 4
_ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*[\"']?\s{0,2}[=:]\s{0,2}[\"']?$")
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)))
CONTEXT = 40

FEATURES = [
    "length", "entropy", "distinct", "digits", "upper", "hex", "switches", "letter_runs", "vowels", "repeats", "covered", "path",
    "dots", "dashes", "at", "assigned", "hint", "harmless", "quoted", "nearest_hint",
]


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values behind a name and a sign."""
    at = 0
    while sign := _SIGN.search(text, at):
        at = start = sign.end()
        quote = text[start : start + 1]
        named = _ASSIGNED.search(text, max(0, sign.start() - CONTEXT), start + (quote in _QUOTED))
        if not named:
            at = sign.start() + 1
            continue
        if quote in _QUOTED:
            at = start = start + 1
            if m := _QUOTED[quote].match(text, start):
                if m.end() - start >= LEAST:
                    yield start, m.end()
                if not re.search(r"\s", m[0]):
                    at = m.end()
                continue
        if m := _BARE.match(text, start):
            value = m[0].rstrip(",;.)]}>\"'")
            if value[-1:] == ":":  # a name itself
                continue
            if len(value) >= LEAST:
                yield start, start + len(value)
            at = start + len(value)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what is worth a look, by start. Only quoted values with blanks may hold others."""
    at = 0
    mixed = lambda s: any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    for a, b in _assigned(text):
        yield from ((m.start(), m.end()) for m in _RUN.finditer(text, at, max(at, a)) if mixed(m[0]))
        yield a, b
        at = max(at, a if re.search(r"\s", text[a:b]) else b)
    yield from ((m.start(), m.end()) for m in _RUN.finditer(text, at) if mixed(m[0]))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(before: str, s: str, after: str) -> list[float]:
    n = len(s)
    counts = Counter(s)
    kinds = [_kind(c) for c in s]
    low, near = s.lower(), before.lower()
    runs = [len(x) for x in re.findall(r"[A-Za-z]+", s)]
    hint = max(near.rfind(h) for h in HINTS)
    return [
        float(n), -sum(c / n * math.log2(c / n) for c in counts.values()), len(counts) / n, kinds.count(0) / n, kinds.count(2) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        float(max(runs, default=0)), sum(c in "aeiou" for c in low) / n, sum(a == b for a, b in zip(s, s[1:])) / max(1, n - 1),
        sum(len(m[0]) for m in _WORDS.finditer(low)) / n, float(s.count("/") > 1 or before.endswith(("/", "\\"))), float(s.count(".")),
        float(s.count("-")), float("@" in s), float(bool(_ASSIGNED.search(before))), float(hint >= 0),
        float(any(h in near for h in HARMLESS)), float(before.endswith(("'", '"')) and after.startswith(("'", '"'))),
        float(len(near) - hint) if hint >= 0 else 99.0,
    ]


def labelled_findings(rows: int = 4000, seed: int = 17) -> list[tuple[str, str, str, int]]:
    """Findings with labels: keys and passwords as people leave them in texts, and look-alikes that are none."""
    r = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                 "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    text = lambda a, n: "".join(r.choice(a) for _ in range(n))
    word = lambda: r.choice(DICTIONARY)
    some = lambda n: " ".join(word() for _ in range(n))
    case = lambda s: r.choice((str.lower, str.upper, str.title, str))(s)
    out = []
    for _ in range(rows):
        lead = some(r.randint(0, 5)) + r.choice((" ", ". ", "\n", ", "))
        sign, quote = r.choice((" = ", "=", ": ", ":")), r.choice(('"', '"', "'", ""))
        if r.random() < 0.5:
            name = r.choice(("token", "api_key", "apikey", "secret", "secret_key", "password", "access_key", "auth_token", "client_secret", "key", "credential", "private_key", "bearer"))
            kind = r.random()
            s = text(r.choice(alphabets), r.choice((16, 20, 24, 32, 36, 40, 40, 48, 64))) if kind < 0.8 else (
                text("abcdefghijklmnopqrstuvwxyz", r.randint(3, 6)) + text("0123456789!_-", r.randint(2, 4)) + text(alphabets[2], r.randint(4, 8)))
            if r.random() < 0.1:
                s = r.choice(("sk-", "ghp_", "AKIA", "xoxb-", "pk_live_")) + text(alphabets[2], r.randint(16, 36))
            out.append((case(lead + name + sign) + quote, s, quote + " " + some(2), 1))
            continue
        kind = r.randrange(9)
        if kind == 0:  # digests and revisions
            out.append((lead + r.choice(("commit ", "sha256: ", "md5 = ", "checksum: ", "etag: ", "revision ")), text(alphabets[0], r.choice((32, 40, 64))), " " + some(2), 0))
        elif kind == 1:  # placeholders
            s = r.choice(("xxxxxxxxxxxxxxxx", "your_token_here", "changeme", "insert_key_here", "example-secret-key", "0000000000000000", "<none>_token", "none_given", "password"))
            out.append((case(lead + r.choice(("token", "api_key", "secret", "password")) + sign) + quote, s, quote + " " + some(1), 0))
        elif kind == 2:  # addresses of pages and files
            out.append((lead + r.choice(("", "https://", "/")), "/".join([word(), word(), word() + str(r.randint(1, 999)), word() + r.choice((".html", ".png", ".py", ""))]), " " + some(2), 0))
        elif kind == 3:  # mail
            out.append((lead, f"{word()}{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", " " + some(2), 0))
        elif kind == 4:  # numbers
            out.append((lead + r.choice(("", "order: ", "phone = ", "id=")), text("0123456789", r.choice((10, 12, 16))), " " + some(2), 0))
        elif kind == 5:  # identifiers
            out.append((lead + r.choice(("uuid: ", "id = ", "")), "-".join(text(alphabets[0], n) for n in (8, 4, 4, 4, 12)), " " + some(2), 0))
        elif kind == 6:  # names with numbers
            out.append((lead + r.choice(("", "name = ", "version: ")), "_".join([word(), word(), word()]) + str(r.randint(1, 9999)), " " + some(2), 0))
        elif kind == 7:  # plain words after a sign
            out.append((lead + r.choice(("note: ", "title = ", "key: ", "author: ")), word() + word(), " " + some(2), 0))
        else:  # words run together, sentence ends without blanks
            out.append((lead, f"{word()}.{r.randint(1, 99)}{word()}{word()}.{word()}", " " + some(2), 0))
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]], trees: int = 24, depth: int = 7, seed: int = 3) -> list[Tree]:
    """A forest of trees whose leaves are shares of secrets."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import RandomForestRegressor

    rows = [(Vectors.dense(features(b[-CONTEXT:], s, a[:CONTEXT])), float(y)) for b, s, a, y in findings]
    table = spark.createDataFrame(rows, ["x", "label"])
    model = RandomForestRegressor(featuresCol="x", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(table)
    return [parse(t.toDebugString) for t in model.trees]


@functools.lru_cache(maxsize=1)
def _default(application: str, rows: int) -> list[Tree]:
    return train(SparkSession.getActiveSession(), labelled_findings(rows))


def default_forest(spark: SparkSession, rows: int = 4000) -> list[Tree]:
    return _default(spark.sparkContext.applicationId, rows)


def find(text: str | None, forest: list[Tree]) -> list[tuple[int, int, float]]:
    """(start, end, probability) of every candidate of a text."""
    out = []
    for a, b in candidates(text or ""):
        x = features(text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT])
        out.append((a, b, sum(value(t, x) for t in forest) / len(forest)))
    return out


def scan(docs: DataFrame, forest: list[Tree], threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start and end (code points), length, probability, secret.

    NULL and empty texts have none; a NULL doc_id is carried along; repeated rows give repeated findings; long texts are
    scanned whole. Extra columns are not carried and the secret itself is not in the result. An empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [
                (i, a, b, b - a, p)
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for a, b, p in find(t, forest)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start int, end int, length int, probability double")
    return found.withColumn("secret", F.col("probability") >= threshold)


def redact(docs: DataFrame, forest: list[Tree], threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced; all rows and columns stay, `n_chars` follows where there is one."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for a, b, p in find(text, forest):
                if p >= threshold and b > at:
                    out += [text[at:a], mark] if a >= at else []
                    at = b
            return "".join(out) + text[at:] if out else text

        return texts.map(one, na_action=None)

    names = docs.columns
    out = docs.withColumn("text", clean("text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)
