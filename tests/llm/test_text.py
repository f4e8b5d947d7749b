"""Decontamination, language proportions, chat formatting and token files."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbook.llm import chat, decontam, langid, queries, simple8b
from test_exact_mixing import docs

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------- decontamination

def brute_hits(words, items, window):
    hit, found = set(), set()
    for k, item in items.items():
        n = min(len(item), window)
        wins = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(k)
    return len(hit), found


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_automaton_against_brute_force(window):
    rng = random.Random(window)
    for _ in range(60):
        items = {str(k): [rng.choice("abc") for _ in range(rng.randint(0, 9))] for k in range(5)}
        a = decontam.build([[w.encode() for w in v] for v in items.values()], window)
        texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(4)]
        count, hits, found = decontam.scan(a, [t.encode() for t in texts])
        for t, c, h, f in zip(texts, count, hits, found, strict=True):
            n, ids = brute_hits(t.split(), items, window)
            assert c == len(t.split()) and sum(y - x for x, y in h) == n
            assert {list(items)[k] for k in f} == ids


def test_decontamination_cases(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, "Short Item"), (3, None), (4, "!!"), (None, passage),
                                   (1, passage)], "item_id bigint, text string")
    rows = [(1, f"Intro, {passage.upper()}! end", "s"), (2, "a short-item here", "s"), (3, None, "s"),
            (4, "", "s"), (5, "plain | text", "s"), (6, "short", "s"), (6, "short", "s"),
            (7, "filler " * 5000 + passage, "s")]
    df = docs(spark, rows).selectExpr("*", "1 AS n")
    for block_words in (50_000, 10):
        got = {r["doc_id"]: r for r in decontam.find_contamination(
            df, items, block_words=block_words).withColumn("bad", decontam.contaminated()).collect()}
        assert got[1]["n_hit"] == 20 and got[1]["items"] == ["", "1"] and got[1]["bad"]
        assert got[2]["items"] == ["2"] and [tuple(s) for s in got[2]["spans"]] == [(1, 3)]
        assert got[7]["n_hit"] == 20 and not got[7]["bad"] and got[7]["n_words"] == 5020
        assert not any(got[k]["bad"] for k in (3, 4, 5, 6)) and got[5]["n_words"] == 2
    cleaned = decontam.remove_spans(decontam.find_contamination(df, items)).where("doc_id = 1")
    assert cleaned.first()["text"] == "Intro, end"
    with pytest.raises(ValueError):
        decontam.find_contamination(df.withColumn("spans", F.lit(1)), items)
    assert decontam.find_contamination(df.limit(0), items).count() == 0
    clean = decontam.find_contamination(df, items.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert clean == 0


# ----------------------------------------------------------------- language id

def test_language_id_is_right_on_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_language_id(spark, SF).join(table.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL")
    assert held.count() > 20 and held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_proportions(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("lang IN ('en', 'fr', 'de')")
    model = langid.fit(table)
    some = {r["lang"]: r["text"] for r in table.where("n_chars > 3000").collect()}
    text = {k: v[:3000] for k, v in some.items()}
    rows = [(1, text["en"] + text["fr"], "s"), (2, text["de"], "s"), (3, None, "s"), (4, "", "s"),
            (5, "123 !!", "s"), (6, "a", "s"), (7, (text["en"] + " ") * 200, "s"), (7, text["de"], "s"),
            (8, text["en"] * 2 + text["de"] + text["fr"], "s")]
    df = docs(spark, rows).selectExpr("*", "0 AS sub")
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect() if r["doc_id"] != 7}
    assert set(got[1]["shares"]) == {"en", "fr"}
    assert abs(got[1]["shares"]["en"] - 0.5) < 0.08
    assert got[2]["shares"] == pytest.approx({"de": 1.0}) and got[2]["lang_pred"] == "de"
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (3, 4, 5))
    assert got[6]["lang_pred"] != "und"
    assert got[8]["lang_pred"] == "en" and abs(got[8]["score"] - 0.5) < 0.08 and len(got[8]["shares"]) == 3
    none = langid.predict(df, langid.fit(table.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.predict(df.withColumn("score", F.lit(1)), model)


# ------------------------------------------------------------------------ chat

def messages(spark, rows):
    return spark.createDataFrame(rows, chat.MESSAGE)


def test_reply_tree_branches(spark):
    rows = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "good", 4.0),
            (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "more", 2.0),
            (1, 5, 4, "assistant", "end", 9.0), (1, 6, 3, "user", "x", 1.0),
            (2, 1, 99, "user", "orphan", None), (None, 1, None, "user", "null tree", 1.0),
            (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0),
            (4, 1, 1, "user", "own parent", 1.0)]
    got = {(r["tree"], r["leaf"]): r for r in chat.format_paths(messages(spark, rows), top_k=1).collect()}
    assert set(got) == {(1, 5), (2, 1), (None, 1), (4, 1)}
    best = got[(1, 5)]
    assert [t for _, t in chat.parse(best["formatted"])] == ["root", "good", "more", "end"]
    assert best["score"] == pytest.approx((0 + 4 + 2 + 9) / 4) and best["n_turns"] == 4
    assert [best["formatted"][s["start"]:s["end"]] for s in best["loss"]] == ["good", "end"]
    every = chat.format_paths(messages(spark, rows), top_k=None)
    assert every.where("tree = 1").count() == 2
    assert chat.format_paths(messages(spark, rows).limit(0)).count() == 0


def test_control_strings_and_long_paths(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "\\p \\b \\n \\", "<\\p|", "<<||", "é\\<|🙂", "", None]
    rows = [(7, i, i - 1 if i else None, ["user", "assistant", "a\nb", None][i % 4], nasty[i % len(nasty)], 0.0)
            for i in range(150)]
    r = chat.format_paths(messages(spark, rows)).first()
    assert chat.parse(r["formatted"]) == [(x[3] or "", x[4] or "") for x in rows]
    assert r["formatted"].count("<|im_start|>") == 150
    learnt = "".join(chat.unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss"])
    assert learnt == "".join(x[4] or "" for x in rows if x[3] == "assistant")


def test_linear_conversations_with_ties(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b", 1), (1, 0, "assistant", "a", 1), (1, None, None, None, 1),
                                   (None, 0, "user", "n", 1)],
                                  "conv_id bigint, turn bigint, role string, text string, node int")
    got = {r["tree"]: chat.parse(r["formatted"]) for r in
           chat.format_paths(chat.linear_messages(turns)).collect()}
    assert got == {1: [("", ""), ("assistant", "a"), ("user", "b")], None: [("user", "n")]}


# ----------------------------------------------------------------- token files

@pytest.mark.parametrize("top", [2, 300, 50257, 2 ** 40, 2 ** 64 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    sizes = rng.integers(0, 500, 40)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, top, bounds[-1], dtype=np.uint64)
    ids[rng.random(len(ids)) < 0.4] >>= np.uint64(50 if top > 2 ** 60 else 3)
    coded = simple8b.encode_streams(ids, bounds)
    assert (simple8b.decode_streams([w for w, _ in coded], sizes) == ids).all()
    # A block decodes on its own.
    for k in np.flatnonzero(sizes > 2 * simple8b.BLOCK)[:3] if top < 2 ** 60 else []:
        words, blocks = coded[k][0], np.frombuffer(coded[k][1], "<u4")
        part = words[8 * blocks[1]:8 * blocks[2]]
        want = ids[bounds[k]:bounds[k + 1]][simple8b.BLOCK:2 * simple8b.BLOCK]
        assert (simple8b.decode_streams([part], np.array([simple8b.BLOCK])) == want).all()
    if top == 2:
        assert sum(len(w) for w, _ in coded) < 0.4 * len(ids)


def test_pieces_agree_with_the_tokenizer():
    p = simple8b.Pieces(queries.tokenizer_path())
    rng = random.Random(5)
    texts = ["", "a  b", "a \nb", "\n a", "a\tb c", "a b ", "  ", "it's don't 'll x's", "é b　c", "x\0y z",
             "a<|endoftext|>b", "(ab) ab!!!| %%%x x%%% ab12, É, 日本語。 oḱ ²x", "naïve—dash … end."]
    texts += ["".join(rng.choice("ab é'.,!\n  日1") for _ in range(30)) for _ in range(400)]
    assert p(texts) == [x if t else b"" for t, x in zip(texts, p._encode(texts), strict=True)]


def test_ids_are_those_of_the_plain_tokenizer():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "a <|endof b"]
    got = simple8b.Pieces(queries.tokenizer_path())
    assert [np.frombuffer(x, got.kind).tolist() for x in got(texts)] == \
        [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_tails_just_above_the_widest_pack():
    ids = np.array([2**60, 2**60 + 5, 2**61 - 1, 2**60, 3], np.uint64)
    coded = simple8b.encode_streams(ids, np.array([0, 3, 5]))
    assert (simple8b.decode_streams([w for w, _ in coded], np.array([3, 2])) == ids).all()


def test_token_files_hold_the_whole_stream(spark, tmp_path):
    rows = [(5, "later text", "s"), (1, "", "s"), (2, None, "s"), (None, "null id", "s"), (3, "x " * 60000, "s"),
            (4, "same", "s"), (4, "same", "s"), (4, "other", "s")]
    path = str(tmp_path / "tokens")
    df = docs(spark, rows).selectExpr("*", "1 AS id", "2 AS shard")
    simple8b.write_token_files(df, path, queries.tokenizer_path())
    got = simple8b.read_token_files(spark, path).orderBy("start").collect()
    p = simple8b.Pieces(queries.tokenizer_path())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t, _) in zip(got, want, strict=True):
        ids = np.frombuffer(p([t or ""])[0], p.kind).tolist() + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["token_ids"]) == (i, at, len(ids), ids)
        at += len(ids)
    crc = simple8b.read_token_files(spark, path, ids=False).where("doc_id = 5").first()["ids_crc32"]
    assert crc == zlib.crc32(np.array(got[-1]["token_ids"], "<u4").tobytes())
    empty = str(tmp_path / "none")
    simple8b.write_token_files(df.limit(0), empty, queries.tokenizer_path())
    assert simple8b.read_token_files(spark, empty).count() == 0
