"""Secret scan with a random forest that removes false positives.

1. Candidates: runs of at least ``MIN_LENGTH`` characters of keys and tokens
   (``[A-Za-z0-9+/=_-]``) in the whole text, and values of at least ``MIN_KEYED`` characters
   (marks of passwords too) that are assigned to a key word.
2. Corpus statistics over all rows: transitions between characters and the letter
   trigrams that make up ``COMMON`` of all trigrams (the dictionary); two tables of
   65,536 counts.
3. Features: length, mean log-likelihood of the character transitions, share of digits,
   of upper-case letters and of changes between classes, distinct characters, entropy,
   share of the candidate that dictionary trigrams cover, features of the path (the file
   or source name the text came from: depth, test or example names, digits), and of the
   neighbourhood (assignment sign, quotes, key words before it).
4. A random forest (Spark ML), trained on labelled findings, at most ``MAX_TRAINING``
   of them (a documented bound, chosen by hash, half of it at most for either label),
   and on reference findings, made from documented credential forms and from look-alikes,
   scores every candidate.  Reference and labelled findings of a label weigh the same.

Cases: null or empty text has no candidate; a null path has zero path features; repeated
rows give repeated findings; without labelled findings of both labels, reference findings
included, no forest can be trained and the candidates come back without a judgement (null); extra columns are
ignored; an empty table gives no candidates.
"""

from __future__ import annotations

import base64
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import chunks, flat, rows_of
from matchbook.llm.langid import CELLS, trigrams

MIN_LENGTH = 16
MIN_KEYED = 8
MAX_TRAINING = 20_000
MAX_PATHS = 64           # paths of the corpus, in order, under which reference texts stand
COMMON = 0.95
TREES, DEPTH = 20, 6
FEATURES = ("length", "transition", "digits", "upper", "changes", "distinct", "entropy",
            "dictionary", "path_depth", "path_example", "path_digits", "assigned", "quoted", "key_word")

_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_\-]{%d,}={0,2}" % MIN_LENGTH)
#: A value behind an assignment sign; whether it counts depends on the word before that.
_ASSIGNED = re.compile(rb"[=:]>?[ \t]{0,3}(?:(?:bearer|basic)[ \t]+)?[\"']?"
                       rb"([A-Za-z0-9+/_\-.!@#$%%^&*~?]{%d,}={0,2})" % MIN_KEYED, re.I)
_BEFORE = re.compile(rb"(\w*)\W{0,4}\Z", re.I)
#: Parts of a name ("apiKey", "API_KEY"), and the parts that make it a key word.
_PART = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_KEY = re.compile(rb"(?:access|account|admin|api|app|auth|client|db|master|my|private|root|secret"
                  rb"|service|sign|signing|user)*(?:tok|token|key|secret|pass|passcode|passphrase"
                  rb"|passwd|password|pwd|auth|bearer|cred|credential|private)s?", re.I)
_EXAMPLE = re.compile(r"test|example|sample|mock|doc", re.I)
#: Class of a byte: 0 other, 1 digit, 2 lower case, 3 upper case.
_KIND = np.zeros(256, np.uint8)
_KIND[48:58], _KIND[97:123], _KIND[65:91] = 1, 2, 3

FINDING = "row bigint, id bigint, at bigint, finding string, " + ", ".join(
    f"{f} double" for f in FEATURES)


def corpus_statistics(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of a byte after another, whether a trigram cell is common), both of
    65,536 entries, from all rows of ``text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets, 1 << 20):
                x = data[offsets[i]:offsets[j]]
                if len(x) >= 3:
                    pair = (x[:-1].astype(np.uint16) << 8) | x[1:]
                    n[0] += np.bincount(pair, minlength=CELLS)
                    n[1] += np.bincount(trigrams(x), minlength=CELLS)
        kind, cell = np.nonzero(n)
        yield rows_of(["kind", "cell", "n"], kind.astype(np.int32), cell.astype(np.int32),
                      n[kind, cell])

    sums = (texts.mapInArrow(count, "kind int, cell int, n bigint").groupBy("kind", "cell")
            .agg(F.sum("n").alias("n")).toPandas())
    n = np.zeros((2, CELLS))
    n[sums["kind"].to_numpy(np.int64), sums["cell"].to_numpy(np.int64)] = sums["n"]
    pairs = n[0].reshape(256, 256) + 0.1
    steps = np.log(pairs / pairs.sum(axis=1, keepdims=True)).reshape(-1)
    order = np.argsort(-n[1], kind="stable")
    common = np.zeros(CELLS, bool)
    total = np.cumsum(n[1][order])
    common[order[:int(np.searchsorted(total, COMMON * total[-1])) + 1]] = n[1].any()
    return steps.astype(np.float32), common


def _context(before: bytes) -> tuple[bool, bytes, bool]:
    """Whether a quote stands before a candidate, what stands before that, and whether its
    last word is a key word."""
    left = before.rstrip()
    bare = left.rstrip(b"\"'").rstrip()
    word = _BEFORE.search(bare)
    return (left[-1:] in (b'"', b"'"), bare,
            bool(word and any(_KEY.fullmatch(part) for part in _PART.findall(word[1]))))


def spans(text: bytes) -> list[tuple[int, int]]:
    """Start and end of every candidate of a text, in order."""
    found = [m.span() for m in _CANDIDATE.finditer(text)]
    keyed = [m.span(1) for m in _ASSIGNED.finditer(text)
             if _context(text[max(0, m.start(1) - 40):m.start(1)])[2]]
    if not keyed:
        return found
    starts = np.array([a for a, _ in found] + [len(text)])
    ends = np.array([0] + [b for _, b in found])
    for a, b in keyed:                       # those that no longer run overlaps
        k = int(np.searchsorted(starts, b))
        if ends[k] <= a:
            found.append((a, b))
    return sorted(found)


def features(found: bytes, before: bytes, after: bytes, path: str | None,
             steps: np.ndarray, common: np.ndarray) -> list[float]:
    x = np.frombuffer(found, np.uint8)
    kind = _KIND[x]
    n = len(x)
    pair = (x[:-1].astype(np.int64) << 8) | x[1:]
    covered = np.zeros(n, bool)
    for k in np.flatnonzero(common[trigrams(x)] & (kind[:-2] != 1)):
        covered[k:k + 3] = True
    counts = np.array(list(Counter(found).values())) / n
    quote, bare, key = _context(before)
    path = path or ""
    return [n, float(steps[pair].mean()), float((kind == 1).mean()), float((kind == 3).mean()),
            float((kind[1:] != kind[:-1]).mean()), float(len(counts)),
            float(-(counts * np.log2(counts)).sum()), float(covered.mean()),
            float(path.count("/")), float(bool(_EXAMPLE.search(path))),
            float(sum(c.isdigit() for c in path)), float(bare[-1:] in (b"=", b":")),
            float(quote and after[:1] in (b'"', b"'")), float(key)]


def candidates(docs: DataFrame, statistics, id_col: str = "doc_id", text_col: str = "text",
               path_col: str | None = None) -> DataFrame:
    """row, id, at (byte offset), finding and features of every candidate."""
    shared = docs.sparkSession.sparkContext.broadcast(statistics)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, common = shared.value
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            ids, rows = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            paths = batch.column("path").to_pylist()
            for i, j in chunks(offsets):
                out = []
                for k in range(i, j):
                    text = data[offsets[k]:offsets[k + 1]].tobytes()
                    for a, b in spans(text):
                        out.append([rows[k], ids[k], a, text[a:b].decode(),
                                    *features(text[a:b], text[max(0, a - 40):a], text[b:b + 1], paths[k],
                                              steps, common)])
                if out:
                    cols = list(zip(*out, strict=True))
                    yield rows_of(["row", "id", "at", "finding", *FEATURES],
                                  *(pa.array(c, pa.int64()) for c in cols[:3]),
                                  pa.array(cols[3], pa.string()),
                                  *(pa.array(c, pa.float64()) for c in cols[4:]))

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       path.alias("path")).mapInArrow(scan, FINDING)


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)


#: Documented forms of credentials, which need no context.
FORMS = {"aws": "^(AKIA|ASIA)[A-Z0-9]{16}$", "github": "^gh[pousr]_[A-Za-z0-9]{36,}$",
         "slack": "^xox[abprs]-[0-9A-Za-z-]{10,}$", "google": "^(AIza[0-9A-Za-z_-]{35}|GOCSPX-[0-9A-Za-z_-]{28})$",
         "hugging_face": "^hf_[A-Za-z]{34}$", "shopify": "^shp(at|ca|pa|ss)_[0-9a-fA-F]{32}$",
         "jwt": "^eyJ[A-Za-z0-9_-]{13,}$", "der": "^MII[A-Za-z0-9+/]{29,}={0,2}$"}


#: Values that stand for a secret or for a release, under any name.
PLACEHOLDER = (r"(?i)^[<{$%]|^(.)\1+$|^(your|my|the|some|an?)[-_.]|change[-_]?(me|this)|placeholder"
               r"|example|redacted|dummy|insert[-_]|x{4,}|\*{3,}|1234567|abcdefg")
VERSION = r"^v?[0-9]+([.][0-9]+){1,3}([-+._][A-Za-z0-9]+)*$"
WORDS = 0.8              # dictionary coverage from which a value under a key word is words


def label() -> F.Column:
    """1, 0 or null (not known) for a finding, by rules that stand in for a reviewer: a
    documented form is a secret, and so is a value of letters and digits assigned to a key
    word, unless it is a placeholder, a version, or dictionary words with a number or date
    behind them.  These and plain words are none under a key word either; without a key word,
    neither are words, numbers, UUIDs, hexadecimal digests and slugs of words and numbers."""
    finding = F.col("finding")
    form = finding.rlike("|".join(FORMS.values()))
    keyed = (F.col("assigned") == 1) & (F.col("key_word") == 1)
    mixed = finding.rlike("[0-9]") & finding.rlike("[A-Za-z]")
    common = (~finding.rlike("[0-9]") | finding.rlike("^[0-9+/_-]+$")
              | finding.rlike("^[0-9a-fA-F-]+$")
              | finding.rlike("^[A-Za-z]{3,}([-_/]([A-Za-z]+|[0-9]{1,8}))+$")
              | finding.rlike("^[0-9]{1,8}([-_/]([A-Za-z]+|[0-9]{1,8}))+$"))
    plain = finding.rlike(PLACEHOLDER) | finding.rlike(VERSION) | (
        finding.rlike("^[A-Z]?[a-z]+([-_/.][A-Z]?[a-z]+)*([-_/.][0-9]{1,8})*$")
        & (F.col("dictionary") >= WORDS))
    return (F.when(form, 1).when((F.col("key_word") == 1) & plain, 0).when(keyed & mixed, 1)
            .when((F.col("key_word") == 0) & common, 0))


_WORDS = ("account archive article backup branch building change chapter client config customer "
          "delivery department document feature garden history invoice library machine market "
          "message meeting network number order package picture product project record release "
          "report request school season service station storage summer system version weather "
          "window winter").split()
_SECRET_NAMES = ("password", "api_key", "secret", "auth_token", "client_secret", "private_key",
                 "passwd", "access_key", "token", "credential")
_OTHER_NAMES = ("id", "commit", "md5", "sha256", "order", "checksum", "request", "file", "url",
                "image", "name", "version", "session", "etag", "digest")
REFERENCE = 60                  # examples of each kind


def reference_texts(seed: int = 7) -> list[tuple[int, str, int]]:
    """(number, text, label): made examples, ``REFERENCE`` of each kind.  Secrets come bare or
    assigned, short ones, digits and lower case alone only under a key word, as without one
    they cannot be told from digests; look-alikes come bare or assigned to other names, and
    words also to key words."""
    rng = random.Random(seed)
    alnum, lower = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    pick = lambda chars, a, b=None: "".join(rng.choice(chars) for _ in range(rng.randint(a, b or a)))
    raw = lambda a, b: rng.randbytes(rng.randint(a, b))
    url64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    word = lambda: rng.choice(_WORDS)
    number = lambda: pick(string.digits, 1, 6)
    date = lambda: f"20{rng.randrange(30):02}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    forms = [lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 16),
             lambda: f"gh{rng.choice('pousr')}_{pick(alnum, 36)}",
             lambda: f"xox{rng.choice('abprs')}-{pick(string.digits, 11)}-{pick(alnum, 24)}",
             lambda: "AIza" + pick(alnum + "_-", 35), lambda: "GOCSPX-" + pick(alnum + "_-", 28),
             lambda: "hf_" + pick(string.ascii_letters, 34),
             lambda: f"shp{rng.choice(['at', 'ca', 'pa', 'ss'])}_{raw(16, 16).hex()}",
             lambda: url64(b'{"alg":"HS256","kid":"' + url64(raw(6, 12)).encode() + b'"}'),
             lambda: "MII" + base64.b64encode(raw(45, 45)).decode(),
             lambda: base64.b64encode(raw(15, 64)).decode(), lambda: pick(alnum, 20, 48)]
    keyed = [lambda: raw(8, 32).hex(), lambda: pick(alnum, 16, 48), lambda: pick(lower, 16, 40),
             lambda: url64(raw(16, 40)), lambda: str(uuid.UUID(bytes=rng.randbytes(16), version=4)),
             lambda: pick(alnum + "!@#$%^&*", 8, 15),
             lambda: word().capitalize() + number() + rng.choice("!?#*") + word()]
    none = [lambda: pick(string.digits, 16, 24),
            lambda: str(uuid.UUID(bytes=rng.randbytes(16), version=4)),
            lambda: rng.choice([str.lower, str.upper])(raw(8, 32).hex()),
            lambda: f"{word()}-{date()}-{word()}-{word()}", lambda: f"{date()}-{word()}-{word()}",
            lambda: "/".join([word(), word(), number(), word()]),
            lambda: "_".join([word(), word(), number(), word()]),
            lambda: "-".join(pick(string.digits, 2, 6) for _ in range(5)),
            lambda: word() + word().capitalize() + word().capitalize() + number(),
            lambda: f"{word().upper()}-{pick(string.digits, 8, 14)}", lambda: word() + word() + word()]
    words = [lambda: f"{word()}-{word()}-{word()}", lambda: word() + word(), lambda: f"{word()}_{word()}_{word()}"]

    def put(value: str, names) -> str:
        shape = rng.randrange(4 if names else 1)
        if names is _SECRET_NAMES:
            shape = rng.randint(1, 3)
        name = rng.choice(names) if names else ""
        inner = [value, f'{name} = "{value}"', f"{name}: {value}", f'"{name}": "{value}"'][shape]
        return f"{word()} {word()} {inner} {word()}"

    out = []
    for kinds, names, y in ((forms, (None, _SECRET_NAMES), 1), (keyed, (_SECRET_NAMES,), 1),
                            (none, (None, _OTHER_NAMES), 0), (words, (_SECRET_NAMES,), 0)):
        for kind in kinds:
            out += [(put(kind(), names[i % len(names)]), y) for i in range(REFERENCE)]
    return [(i, text, y) for i, (text, y) in enumerate(out)]


def reference_findings(docs: DataFrame, statistics, path_col: str | None = None) -> DataFrame:
    """Findings with ``label`` in the reference texts, measured with the corpus' statistics and
    under paths of the corpus, so that a path does not tell them from its findings."""
    spark = docs.sparkSession
    paths = [None]
    if path_col:
        path = F.col(path_col).cast("string").alias("path")
        paths = [r[0] for r in docs.select(path).distinct().orderBy("path").limit(MAX_PATHS).collect()] or paths
    rows = [(i, text, paths[i * 7 % len(paths)], y) for i, text, y in reference_texts()]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string, path string, label int")
    found = candidates(texts, statistics, path_col="path")
    return found.join(texts.select(F.col("doc_id").alias("id"), "label"), "id")


def train(labelled: DataFrame, max_training: int = MAX_TRAINING, seed: int = 7,
          reference: DataFrame | None = None) -> RandomForestClassificationModel | None:
    """Forest over findings with their features and a ``label`` of 0 or 1, and over all of
    ``reference``; None without findings of both labels."""
    order = F.xxhash64(F.lit(seed), "finding", "id", "at")
    rows = labelled.select("label", "finding", "id", "at", *FEATURES)
    columns = [F.col("label").cast("double").alias("label"), *FEATURES]
    part = [rows.where(F.col("label") == y).orderBy(order, "finding", "id", "at")
            .limit(max_training // 2).select(*columns, F.lit(0).alias("made")) for y in (0, 1)]
    sample = part[0].unionByName(part[1])
    if reference is not None:
        sample = sample.unionByName(reference.select(*columns, F.lit(1).alias("made")))
    seen = {(r["label"], r["made"]): r["count"]
            for r in sample.groupBy("label", "made").count().collect()}
    parts = Counter(y for y, _ in seen)
    if len(parts) < 2:
        return None
    # Each label weighs the same, and in it the labelled and the reference findings.
    weight = F.lit(None).cast("double")
    for (y, made), n in seen.items():
        weight = F.when((F.col("label") == y) & (F.col("made") == made),
                        1.0 / (n * parts[y])).otherwise(weight)
    sample = sample.withColumn("weight", weight * sum(seen.values()))
    return RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=TREES,
                                  maxDepth=DEPTH, seed=seed).fit(_vectors(sample))


def classify(found: DataFrame, forest: RandomForestClassificationModel | None,
             threshold: float = 0.5) -> DataFrame:
    """row, id, at, finding, probability, is_secret.  Without a forest nothing is known
    about a finding: both are null."""
    if forest is None:
        return found.select("row", "id", "at", "finding", F.lit(None).cast("double").alias("probability"),
                            F.lit(None).cast("boolean").alias("is_secret"))
    p = vector_to_array("probability")[1]
    scored = forest.transform(_vectors(found)).withColumn("p_", p)
    return scored.select("row", "id", "at", "finding", F.col("p_").alias("probability"),
                         (F.col("p_") >= threshold).alias("is_secret"))
