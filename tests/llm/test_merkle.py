"""The Merkle manifest against a tree built in plain Python."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from matchbook.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = (doc, source, lang, n, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        a = at // 16 * 16
        path.append(("".join(level[a:at]), "".join(level[at + 1:a + 16])))
        at //= 16
    return path


def brute(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        part = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = part, levels_of([leaf_of(r) for r in part])
    top = levels_of([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        part, levels = trees[s]
        for i, r in enumerate(part):
            path = path_of(levels, i) + path_of(top, k)
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, copies = leaf_of(r, change), []
            for a, b in path:
                node = h(a + node + b)
                copies.append(node)
            out.append((r[0], leaf_of(r), levels[-1][0], top[-1][0],
                        h("".join(a + b for a, b in path)), node, node == top[-1][0],
                        copies if change else None))
    return out


def answer(spark, rows, schema=SCHEMA, extra=()):
    got = merkle.verify_versions(spark.createDataFrame(rows, schema).selectExpr("*", *extra))
    return [tuple(r)[:7] + ([bytes(d).hex() for d in r.copied] if r.copied is not None else None,)
            for r in got.collect()]


def ordered(rows):
    return sorted(rows, key=str)


CASES = [(1, "A b", "en", "x", 3), (2, "a b", None, "x", None), (None, "N", "en", "x", 1),
         (None, "N", "en", "x", 1), (5, None, "en", None, 0), (6, "", "en", None, 0),
         (7, "Ä é 漢 Z", "de", "ü", 7), (7, "Ä é 漢 Z", "de", "ü", 7), (7, "other", "de", "ü", 7),
         (10, "Q" * 3_000_000, "en", "a long one", 3_000_000), (-4, "T", "en", "", 1)]


def test_cases_against_plain_tree(spark):
    got = answer(spark, CASES, extra=("1 AS pos", "2 AS LEAF", "3 AS n", "4 AS block", "5 AS at"))
    assert ordered(got) == ordered(brute(CASES))


@pytest.mark.parametrize("n", [1, 16, 17, 257, 4096, 4097, 9000])
def test_sizes_around_block_borders(spark, n):
    """One source of n leaves, beside many sources of one leaf."""
    rows = [(i, f"Text {i}", "en", "big", i) for i in range(n)]
    rows += [(100_000 + i, f"Small {i}", "en", f"s{i}", i) for i in range(40)]
    assert ordered(answer(spark, rows)) == ordered(brute(rows))


def test_version_copies_only_ancestors(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "s", 3) for i in range(300)]
    for r in answer(spark, rows):
        assert (r[7] is None) == (zlib.crc32(str(r[0]).encode()) % 5 != 0)
        if r[7] is not None:
            assert len(r[7]) == 3 and r[7][-1] == r[5]         # 300 leaves: three levels
            assert r[6] == (r[0] % 2 == 0)                     # nothing to lower-case


def test_empty_table(spark):
    got = merkle.verify_versions(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and "verified" in got.columns
