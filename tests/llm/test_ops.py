import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import registry
from graphloom.llm.common import Scratch, table
from graphloom.llm.components import components
from graphloom.llm.near import NearConfig
from graphloom.llm.op01_near_dedup import near_dedup, one_of_each
from graphloom.llm.op02_toxicity import ToxicConfig, character_model, readings, toxicity
from graphloom.llm.op03_decontaminate import LeakConfig, budget, contaminated, leaks, myers, normalise, pieces
from graphloom.llm.op04_paragraphs import ParagraphConfig, _few, _many, _shared, repeated_paragraphs, without_repeated_paragraphs
from graphloom.llm.op05_suffix_dedup import SuffixConfig, without_repeats
from graphloom.llm.op06_token_orc import TokenConfig, Words, read_tokens, token_digest, write_tokens
from graphloom.llm.op07_mixing import MixConfig, fit, mixed, rates
from graphloom.llm.op08_quality_rules import LineConfig, cleaned_lines, quality_lines
from graphloom.llm.op09_line_chunks import ChunkConfig, _with_ranges, chunk_ends, collisions, line_hash, repeated_blocks, without_repeated_blocks
from graphloom.llm.op10_url_rules import split_url, url_rules
from graphloom.llm.suffixes import Run, front_code, merge

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "ba do ke li mu no pa ri so tu".split() for b in "n r s t x".split()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3 if i is not None else 0}", len(t or "")) for i, t in rows], SCHEMA)


def passage(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


#: Nulls, empty and white-space texts, ties and a text of one word.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (905, "ONE")]


@pytest.fixture(scope="module")
def copies():
    """Near copies of two texts, in a chain of edits, and unrelated ones."""
    rng = random.Random(5)
    rows, text = [], passage(rng, 60).split()
    for i in range(30):
        rows.append((i, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(60)] = rng.choice(VOCABULARY)
    rows += [(100 + i, passage(rng, 40)) for i in range(10)]
    rows += [(200 + i, rows[3][1].upper() + "\n") for i in range(5)]
    return rows + ODD


def test_near_dedup_equals_brute_force(spark, copies):
    for config in (NearConfig(width=4), NearConfig(), NearConfig(block=4)):
        found = {r.doc_id: r for r in near_dedup(frame(spark, copies), config).collect()}
        sets = {i: brute.shingle_set(t, config.width) for i, t in copies}
        expected = brute.components(sets)
        assert {i: r.component_id for i, r in found.items()} == expected
        assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
        assert all(r.kept == (i == r.component_id) for i, r in found.items())


def test_near_dedup_odd_tables(spark):
    empty = frame(spark, [])
    assert near_dedup(empty).count() == 0 and one_of_each(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (None, "a b c d e f"), (None, None), (2, "A b c d e f")]
    kept = one_of_each(frame(spark, rows).withColumn("row", F.lit("clash")).withColumn("component", F.lit(1)))
    assert kept.columns == [*SCHEMA.replace(",", "").split()[::2], "row", "component"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == [(False, 1, "a b c d e f"), (False, 1, "x y z"), (True, 0, "")]


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000 + 7 * i, 1000) for i in range(1, 50)] + [(5000, 5001), (5001, 5000), (6, 6)]
    rng.shuffle(links)
    got = dict(components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long").repartition(7)).collect())
    assert got == {i: 0 for i in range(1, 201)} | {1000 + 7 * i: 1000 for i in range(1, 50)} | {5001: 5000}


def test_readings():
    docs = pa.array(["the idiot is a clown and a loser"] * 50)
    from graphloom.llm.op02_toxicity import _trigrams

    rows = next(_trigrams([pa.RecordBatch.from_arrays([docs], ["text"])]))
    n = np.zeros(28**3)
    n[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    n = n.reshape(28, 28, 28)
    costs = -np.log((n + 0.01) / (n.sum(2, keepdims=True) + 0.28))
    for token, word in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "cl0wn": "clown", "idiooooot!!!": "idiot", "l0$er": "loser", "clown***": "clown", "the": "the"}.items():
        assert word in readings(token, costs.tolist()), token
    assert readings("2024", costs.tolist()) == [] and readings("", costs.tolist()) == []


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        text = passage(rng, 30).split()
        if i % 5 == 0:
            text[7] = rng.choice(["wretch", "vermin"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    tests = [(1000, "w r e t c h"), (1001, f"{passage(rng, 9)} v3rm1n x"), (1002, f"{passage(rng, 9)} w.r.e.t.c.h"), (1003, "wretchhhhh"), (1004, passage(rng, 50)), *ODD, (None, "vermin"), (7, "vermin"), (7, "vermin")]
    docs = frame(spark, rows + tests).withColumn("extra", F.lit(1))
    scored = toxicity(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), extra=("source",))
    got = [(r.doc_id, r.text, r.score) for r in scored.collect()]
    score = {i: s for i, _, s in got}
    assert len(got) == len(rows) + len(tests)
    assert all(score[i] >= 0.7 for i in (1000, 1001, 1002, 1003, None)) and score[1004] < 0.7
    assert all(score[i] == 0 for i, _ in ODD if i < 903)
    assert all((s >= 0.7) == (i % 5 == 0) for i, t, s in got if i is not None and i < 400 and t != "vermin")
    assert toxicity(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_held_out(spark):
    """Labels that were not learnt are met; the small tables' labels hold some noise."""
    sf = "/root/testdata/sf0.1"
    from graphloom.llm.op02_toxicity import op2_toxicity

    both = op2_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out and quality = 1").toPandas()
    toxic = both.toxic == 1
    assert both[toxic].predicted.mean() > 0.9 and both[~toxic].predicted.mean() < 0.05


def test_myers_equals_the_table():
    rng = random.Random(2)
    for _ in range(300):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 70)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 90)))
        bits = [0] * 256
        for i, ch in enumerate(p):
            bits[ch] |= 1 << i
        assert myers(bits, len(p), t, len(p)) == brute.edit_inside(p, t)
    for n in (1, 19, 20, 100, 399):
        item = bytes(range(97, 97 + 20)) * 20
        parts = pieces(item[:n], budget(item[:n], 5))
        assert b"".join(x for _, x in parts) == item[:n] and len(parts) == n * 5 // 100 + 1


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, passage(rng, 30)) for k in range(12)] + [(50, None), (51, ""), (52, "...")]
    rows = []
    for i in range(60):
        text = passage(rng, 40)
        if i % 3 == 0:
            leak = list(items[i % 12][1])
            for _ in range(i % 12):
                leak[rng.randrange(len(leak))] = rng.choice("abcdefgh")
            text = f"{passage(rng, 10)}, {''.join(leak).upper().replace(' ', ',\n')} {text}"
        rows.append((i, text))
    rows += ODD
    docs = frame(spark, rows).withColumn("item_ids", F.lit("clash"))
    got = {r.doc_id: dict(zip(r.item_ids, r.distances)) for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in rows:
        expected = {}
        for k, item in items:
            p = normalise(item)
            if p and (d := brute.edit_inside(b" " + p + b" ", b" " + normalise(text) + b" ")) <= len(p) * LeakConfig().edits_percent // 100:
                expected[k] = d
        assert got[i] == expected, i
    assert sum(map(bool, got.values())) > 5
    assert contaminated(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = contaminated(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where(F.size("item_ids") > 0).count() == 0
    small = contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), LeakConfig(block_bytes=300, blocks=2))
    assert small.columns == [*docs.columns[:-1], "item_ids", "distances"]
    assert {r.doc_id: dict(zip(r.item_ids, r.distances)) for r in small.collect()} == got
    clash = docs.select("*", *[F.lit(x).alias(x) for x in ("a", "b", "a_", "salt", "salt_", "rest", "x")])
    salted = contaminated(clash, spark.createDataFrame(items, "item_id long, text string"), LeakConfig(block_bytes=300, blocks=1, broadcast_bytes=0)).collect()
    assert sorted((r.doc_id, r.item_ids) for r in salted) == sorted((r.doc_id, r.item_ids) for r in small.collect()) and all(r[x] == x for r in salted for x in ("a", "b", "salt", "rest", "x"))
    assert leaks(b" nothing ", [(1, normalise("abc def"))], 5) == {}
    assert leaks(normalise("the party was long"), [(1, b"art"), (2, b"part")], 8) == {} and leaks(normalise("The ART, was"), [(1, b"art")], 8) == {1: 0}
    long = "".join(rng.choice("abcdefgh ") for _ in range(300000))  # a very long text, an item across its end
    assert leaks(normalise(long), [(1, normalise(long[200000:200400]).strip()), (2, normalise(long[-300:]))], 8).keys() == {1, 2}


def test_paragraphs_equal_brute_force(spark):
    rng = random.Random(6)
    base = [passage(rng, 20) + "." for _ in range(6)]
    near = base[0].split()
    near[19] = "zz."
    rows = [(1, f"{base[0]} {base[1]}"), (2, f"{passage(rng, 12)}. {' '.join(near)} tail"), (3, f"{base[2]}\n{base[1]}\n{base[1]}"), (5, passage(rng, 30)), *ODD]
    six = "two of the six words here."
    rows += [(4, " ".join([six] * 30)), (6, f"own start {six} {six} own end"), (7, "Short! " + passage(rng, 40)), (8, "é ü. " * 9 + "\nsolo\n" + base[3].upper())]
    rows += [(20 + i, f"{passage(rng, 9)} {base[4]} {passage(rng, 7)}. {base[5]}\r\n{base[3]}") for i in range(5)]
    long = passage(rng, 60).split()
    for i in range(12):  # a chain of edits: each is near the next, the ends are not
        rows.append((40 + i, " ".join(long)))
        long[rng.randrange(60)] = "new"
    rows.append((60, f"{base[0]}\n" + (passage(rng, 50) + ". ") * 400))  # a long text
    expected = brute.paragraphs(rows)
    assert expected[1] == [] and expected[5] == [] and expected[7] == [] and len(expected[4]) == 1 and expected[3]
    for config in (ParagraphConfig(), ParagraphConfig(block=3)):
        got = {r.doc_id: brute.merged((x.begin, x.stop) for x in r.spans or []) for r in repeated_paragraphs(frame(spark, rows).withColumn("d1", F.lit(1)).withColumn("spans", F.lit("x")), config).collect()}
        assert got == expected
    counts = {r.doc_id: (r.n_paragraphs, r.n_bytes, r.n_removed, r.n_spans) for r in without_repeated_paragraphs(frame(spark, rows)).collect()}
    for i, t in rows:
        assert counts[i] == (sum(bool(brute.words(x)) for x in (t or "").split("\n")), len((t or "").encode()), sum(b - a for a, b in expected[i]), len(expected[i]))
    assert repeated_paragraphs(frame(spark, [])).count() == 0
    many = [(i, " ".join(base[0].split()[:19] + [f"w{i}."])) for i in range(60)]  # one bucket over several blocks
    spans = {r.doc_id: len(r.spans or []) for r in repeated_paragraphs(frame(spark, many), ParagraphConfig(block=7)).collect()}
    assert spans == {i: int(i > 0) for i in range(60)}
    same = frame(spark, [(1, base[0]), (1, base[0]), (None, base[0]), (1, base[0] + " x")])
    assert sorted((r.doc_id or 0, r.text, len(r.spans or [])) for r in repeated_paragraphs(same).collect()) == [(0, base[0], 0), (1, base[0], 1), (1, base[0], 1), (1, base[0] + " x", 2)]


def test_shared_bucket_rows_over_batches():
    rng = random.Random(8)
    rows = sorted((rng.randrange(40), rng.randrange(4)) for _ in range(120))
    units = {k: sorted({u for x, u in rows if x == k}) for k, _ in rows}
    expected = sorted((k, u) for k, us in units.items() if len(us) > 1 for u in us)
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[at : at + size]], pa.int64()) for i in (0, 1)], ["key", "unit"]) for at in range(0, len(rows), size)]
        assert sorted(tuple(x.values()) for b in _shared(iter(batches)) for x in b.to_pylist()) == expected


def test_links_of_small_and_large_blocks_join_the_same():
    rng = random.Random(9)
    sets = [np.unique(np.array([rng.randrange(30) + 100 * (i % 3) for _ in range(60)], np.uint64)) for i in range(60)]
    for side in ([0] * 60, [i % 2 for i in range(60)]):
        joins = []
        for linked in (_few, _many):
            parent = list(range(60))
            for i, j in linked(sets, list(range(60)), side, 80):
                parent = [parent[i] if p == parent[j] else p for p in parent]
            joins.append([parent.index(p) for p in parent])
        assert joins[0] == joins[1] and len(set(joins[0])) < 40


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(500)]
    for n in (1, 2, 3, 7):
        runs = []
        for k in range(n):
            own = sorted(strings[k::n])
            shared, rest = front_code(own)
            runs.append(Run(shared, [len(x) for x in own], rest, list(range(len(own)))))
        got = list(merge(runs))
        assert [s for s, _, _ in got] == sorted(strings)
        for (a, _, _), (b, k, _) in zip(got, got[1:]):
            assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])
    assert list(merge([])) == []


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    shared = [passage(rng, 40) for _ in range(3)]
    rows = [(i, f"{passage(rng, 20)} {rng.choice(shared)[rng.randrange(60) :]} {passage(rng, 5)}é{rng.choice(shared)}") for i in range(40)]
    rows += [(50, "x" * 450), (51, "x" * 99), (52, "ab" * 300), (53, "x" * 101), (60, rows[5][1]), (61, rows[5][1]), *ODD]
    got = {r.doc_id: tuple(r)[1:4] for r in without_repeats(frame(spark, rows)).collect()}
    expected = brute.suffix_dedup(rows)
    assert got == {i: x[:3] for i, x in expected.items()}
    for config in (SuffixConfig(run_bytes=2000, block=10), SuffixConfig(hot=3, block=10, part_bytes=500)):
        assert {r.doc_id: tuple(r)[1:4] for r in without_repeats(frame(spark, rows), config).collect()} == got
    assert without_repeats(frame(spark, [])).count() == 0


def test_windows_of_long_texts_and_zero_bytes(spark, monkeypatch):
    from graphloom.llm import op05_suffix_dedup as op

    rng = random.Random(15)
    zero = "\0" * 40 + passage(rng, 20) + "\0" * 45
    long = passage(rng, 400)
    rows = [(1, long + zero), (2, passage(rng, 3) + zero + long[100:900]), (3, "\0" * 250), (4, zero[20:] + "\0\0" + zero), (5, long[::-1] + long)]
    expected = {i: x[:3] for i, x in brute.suffix_dedup(rows).items()}
    assert {r.doc_id: tuple(r)[1:4] for r in without_repeats(frame(spark, rows)).collect()} == expected
    c = SuffixConfig()
    buf = np.frombuffer("\n".join([long, zero, long, ""]).encode(), np.uint8)
    ends = np.flatnonzero(buf == 10)
    ends = ends[[len(long) == e or len(long) + 1 + len(zero) == e or e == len(buf) - 1 for e in ends.tolist()]]
    begins = np.append(0, ends[:-1] + 1)
    whole = op.anchors(buf, begins, ends, c)
    monkeypatch.setattr(op, "_PIECE", 137)
    parts = op.anchors(buf, begins, ends, c)

    def windows(found):
        return {w: (x, d, h) for a, b, x, d, h in zip(*(z.tolist() for z in found)) for w in range(a, b + 1)}

    assert windows(parts) == windows(whole) and len(parts[0]) > len(whole[0])


def test_suffix_dedup_of_repeated_ids(spark):
    text = passage(random.Random(1), 60)
    rows = without_repeats(frame(spark, [(1, text), (1, text), (None, text), (2, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed > 0) for r in rows) == [(-1, False), (1, True), (1, True), (2, False)]


def test_suffix_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in registry.queries()["op5_suffix_dedup"](spark, SF).collect()}
    assert got == brute.suffix_dedup(rows)


def test_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    path = TokenConfig().path
    plain = Tokenizer.from_file(path)
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, "a\x01b c\x01 \x1cq\x1d e\u0301 \u0301b ΑΣ o'neill's 12 👍🏽"), (1003, "\u00a0x\u2003y ")]
    out = str(tmp_path / "ids")
    write_tokens(frame(spark, rows), out)
    at, expected = 0, {}
    for i, t in sorted(rows):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        expected[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in token_digest(spark, out).collect()} == expected
    one = read_tokens(spark, out, F.col("doc_id") == 1001).collect()
    assert [r.ids for r in one] == [[2]]
    import pyarrow.orc as orc
    from pathlib import Path

    ids = [i for f in sorted(Path(out).glob("*.orc")) for i in orc.read_table(f).column("doc_id").to_pylist()]
    assert ids == sorted(ids)
    write_tokens(frame(spark, []), str(tmp_path / "none"))
    assert token_digest(spark, str(tmp_path / "none")).count() == 0
    write_tokens(frame(spark, [(None, "x"), (3, "x"), (3, "x"), (3, "y")]), str(tmp_path / "ties"))
    assert [r.start for r in token_digest(spark, str(tmp_path / "ties")).orderBy("start").collect()] == [0, 2, 4, 6]


def test_words_of_a_tokenizer_that_keeps_white_space():
    import public_tokenizers

    w = Words(public_tokenizers.path("byte_bpe_50k.json"), 1 << 10)
    assert not w.apart
    ids, count = w.encode(pa.array(["a  b", "", "\n c"]), 0, 3)
    assert count.tolist()[1] == 0 and len(ids) == count.sum()


def test_words_whose_guessed_numbers_of_ids_would_cancel():
    path = TokenConfig().path
    w = Words(path, 1 << 10)
    for words in (["cafe\u0301", "hello", "m\u00b2"], ["\u0130stanbul", "e\u0301", "x", "o\u0301"], ["ab\u00bd", "na\u0308ive", "don't", "x\u2460"], ["<|endoftext|>", "a\u00a0b", "m\u00b2"]):
        expected = [w.tokenizer.encode(x, add_special_tokens=False).ids for x in words]
        ids, sizes = w._ids(words, np.zeros(len(words), bool))
        assert sizes.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])
        ids, count = w.encode(pa.array([" ".join(words), words[-1]]), 0, 2)
        assert ids.tolist() == sum(expected, []) + expected[-1] and count.tolist() == [len(sum(expected, [])), len(expected[-1])]


def test_words_equal_the_library_on_random_characters():
    w = Words(TokenConfig().path, 1 << 12)
    rng = random.Random(1)
    some = [*"abcXYZéÀß×÷ç019 .,!?'\"<|>$€²½ⅣⅫ\n\t\r\x0b\x0c\x1c\x1f\x00\x7f", "\u0338", "\u0301", "\u0308", "\u00a0", "\u2003", "\u0130", "ǅſΣς", "क़क्षि", "日本語", "😀", "T\u0308", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "cafe\u0301", "x²"]
    for _ in range(300):
        rows = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        ids, count = w.encode(pa.array(rows), 0, len(rows))
        expected = [w.tokenizer.encode(x, add_special_tokens=False).ids for x in rows]
        assert count.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, []), rows
    long = "Ab1,é " * 200000 + "q" * 100000  # one very long text, one very long word
    ids, count = w.encode(pa.array([long, "x"]), 0, 2)
    assert ids.tolist() == w.tokenizer.encode(long + " x", add_special_tokens=False).ids


def rows_read(df):
    """Rows that the file scan of a DataFrame gave out."""
    df._jdf.queryExecution().toRdd().count()
    return _scan(df._jdf.queryExecution().executedPlan()).metrics().apply("numOutputRows").value()


def _scan(plan):
    while plan.children().size():
        plan = plan.children().head()
    return plan


def test_token_files_skip_rows_by_index_and_bloom_filter(spark, tmp_path):
    out = str(tmp_path / "pruned")
    docs = spark.range(0, 60000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    write_tokens(docs, out, TokenConfig(stride=1000))
    assert rows_read(read_tokens(spark, out)) == 30000
    by_index = read_tokens(spark, out, F.col("doc_id") == 20000)
    assert by_index.count() == 1 and rows_read(by_index) <= 1000
    # an odd id lies between a row group's least and greatest; only the Bloom filter can tell that it is absent
    absent = [rows_read(read_tokens(spark, out, F.col("doc_id") == k)) for k in range(10001, 10101, 10)]
    assert absent.count(0) >= 8 and max(absent) <= 1000


def test_mixing(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        rows.append((i, passage(rng, 40) + "." if good else passage(rng, 30).replace(" ", "## ")))
        if i % 2:
            continue
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (9, None, 0)]
    docs, known = frame(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    config = MixConfig(targets={0: 0.1, 1: 0.9})
    mix, _ = fit(docs, known, config)
    got = rates(docs, known, config).toPandas()
    p = np.array(got.p.tolist())
    assert abs(p.sum(1) - 1).max() < 1e-9
    expected = (got.rate.to_numpy()[:, None] * got.n_tokens.to_numpy()[:, None] * p).sum(0)
    assert abs(expected / expected.sum() - [0.1, 0.9]).max() < 1e-3 and (got.rate >= 0).all()
    low = got[got.doc_id.isin([i for i in range(600) if i % 4 == 0])]
    assert low.rate.mean() < 0.6 and got[~got.doc_id.isin(low.doc_id)].rate.mean() > 0.9
    out = mixed(docs.withColumn("copies", F.lit(1)).withColumn("p", F.lit(2)), known, config)
    assert out.columns == [*docs.columns, "copies", "p"] and out.where("copies <> 1 or p <> 2").count() == 0
    assert out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == {r.doc_id: r.copies for r in got.itertuples() if r.copies}
    assert rates(frame(spark, []), known, config).count() == 0
    assert rates(docs, known.limit(0), config).count() == len(rows + ODD)
    starved = fit(docs, known, MixConfig(targets={0: 0.999, 1: 0.001}, tokens=5000.0))[0]
    assert starved.moves and abs(sum(starved.totals["expected"].values()) - 5000) < 500


def test_mixing_posteriors_are_calibrated_on_rows_not_learnt(spark):
    rng = random.Random(21)
    own = {0: VOCABULARY[:20], 1: VOCABULARY[20:40], 2: VOCABULARY[10:30]}
    rows, labels = [], []
    for i in range(1500):
        k = rng.choice([0, 0, 0, 1, 1, 2])
        rows.append((i, " ".join(rng.choice(own[k] if rng.random() < 0.3 else VOCABULARY) for _ in range(25))))
        labels.append((i, k))
    docs = frame(spark, rows)
    learnt = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int")
    c = MixConfig(targets={0: 0.4, 1: 0.4, 2: 0.2})
    got = rates(docs, learnt, c).toPandas().set_index("doc_id")
    p = np.array(got.p.tolist())
    held = np.array([i % 3 == 0 for i in got.index])
    truth = np.array([dict(labels)[i] for i in got.index])
    assert (p.argmax(1) == truth)[held].mean() > 0.75
    for k in range(3):  # of those given a probability, so many are of the domain
        for lo, hi in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.01)):
            some = held & (p[:, k] >= lo) & (p[:, k] < hi)
            assert some.sum() < 30 or abs((truth[some] == k).mean() - p[some, k].mean()) < 0.2
    expected = (got.rate.to_numpy()[:, None] * got.n_tokens.to_numpy()[:, None] * p).sum(0)
    assert abs(expected / expected.sum() - [0.4, 0.4, 0.2]).max() < 0.01 and (got.rate >= 0).all()
    beyond = rates(docs, learnt, MixConfig(targets={0: 0.2, 1: 0.3, 2: 0.5})).toPandas()  # no document is so surely of domain 2
    assert (beyond.rate >= 0).all() and beyond.rate.max() < 1000


def plain_least_squares(a, b):
    """Nonnegative x with the least |a x - b|, by active sets."""
    n = a.shape[1]
    on, x, w = np.zeros(n, bool), np.zeros(n), a.T @ b
    while (~on).any() and w[~on].max() > 1e-13 * np.abs(b).max():
        on[np.argmax(np.where(on, -np.inf, w))] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s[on].min() > 0:
                break
            cut = on & (s <= 0)
            x = x + (x[cut] / np.maximum(x[cut] - s[cut], 1e-300)).min() * (s - x)
            on &= x > 1e-12
        x, w = s, a.T @ (b - a @ s)
    return x


@pytest.mark.parametrize("targets", [{0: 0.05, 1: 0.95}, {0: 0.5, 1: 0.5}, {0: 0.999, 1: 0.001}, {0: 1.0, 1: 0.0}, {0: 0.0, 1: 1.0}])
@pytest.mark.parametrize("tokens", [None, 5e5])
def test_mixing_rates_are_the_least_squares_ones(spark, targets, tokens):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    mix, base = fit(docs, labels, MixConfig(targets=targets, tokens=tokens))
    got = base.select("n_tokens", "p", mix.rate([F.get("p", F.lit(i)) for i in range(2)]).alias("rate")).toPandas()
    a = (got.n_tokens.to_numpy()[:, None] * np.array(got.p.tolist())).T
    target, found = np.array(list(mix.totals["target"].values())), a @ got.rate.to_numpy()
    assert (got.rate >= 0).all() and abs(found - list(mix.totals["expected"].values())).max() < 1e-6 * a.sum()
    assert np.allclose(target, np.array(list(targets.values())) * target.sum())
    best = np.linalg.norm(a @ plain_least_squares(a / a.sum(), target) / a.sum() - target)
    assert abs(np.linalg.norm(found - target) - best) < 2e-6 * target.sum()


def test_mixing_is_native(spark):
    for name in ("op7_mixing", "op8_quality_rules"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_quality_rules(spark):
    line = "this line is on every page of the site"
    rows = [(i, f"{line}\n{passage(random.Random(i), 40)}\n{passage(random.Random(-i - 1), 3)}") for i in range(9)]
    rows += [(30 + i, f"{line}\n{line.upper()} \nx y") for i in range(3)]
    rows += [(40, "a b c d e a b c d e a b c d e f g h i j k l m n o"), *ODD]
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") == 8, None).otherwise("host"))
    verdicts, often = quality_lines(docs.withColumn("row", F.lit(1)).withColumn("line", F.lit(2)), LineConfig(max_docs=10))
    got = {r.doc_id: r for r in verdicts.collect()}
    assert often.count() == 1 and got[0].kept and got[0].n_removed_words == 9 and got[8].n_removed_words == 0
    assert not got[30].kept and got[30].n_removed_words == 18 and got[30].n_dup_lines == 0
    assert got[40].n_repeat_words == 15 and got[40].base_failed and not got[900].kept and got[900].n_words == 0
    assert quality_lines(frame(spark, []))[0].count() == 0


def test_cleaned_lines_equal_brute_force(spark):
    rng = random.Random(13)
    often = [passage(rng, 6) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [passage(rng, 8) for _ in range(3)] + rng.sample(often, rng.randrange(4)) + [rng.choice(["", " \t", often[0].upper() + " "])]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None])))
    rows += [(3, rows[4][1], "a"), (3, rows[4][1], "a"), (None, rows[5][1], "a"), (None, None, None), (70, "", "b"), (71, None, "a"), (72, "\n\n", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (3, 6, 100):
        got = cleaned_lines(docs, LineConfig(max_docs=most)).collect()
        expected = brute.without_frequent_lines(rows, most)
        key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
        assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((i, t) for (i, _, _), t in zip(rows, expected)), key=key)
        lost = sorted((i or -1, len(brute.words(t)) - len(brute.words(x))) for (i, t, _), x in zip(rows, expected))
        assert sorted((r.doc_id or -1, r.n_removed_words) for r in got) == lost and (sum(n for _, n in lost) > 0) == (most < 100)
    assert cleaned_lines(docs.limit(0)).count() == 0


def test_cleaning_of_a_text_of_very_many_lines(spark):
    rng = random.Random(3)
    often = [f"often {i}" for i in range(5)]
    long = [rng.choice(often) if rng.random() < 0.2 else f"line {i}" for i in range(200_000)]
    rows = [(1, "\n".join(long))] + [(10 + i, "\n".join([*often, passage(rng, 30)])) for i in range(12)]
    began = time.time()
    got = {r.doc_id: r for r in cleaned_lines(frame(spark, rows).withColumn("source", F.lit("a")), LineConfig(max_docs=10)).collect()}
    assert got[1].text == "\n".join(x for x in long if x not in often) and got[1].n_removed_words == 2 * sum(x in often for x in long)
    assert got[11].text == rows[2][1].split("\n")[-1]
    assert time.time() - began < 60  # a step of a square of the lines takes an hour


def test_quality_query_returns_cleaned_texts(spark):
    import hashlib

    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "source").collect()]
    expected = brute.without_frequent_lines(rows, LineConfig().max_docs)
    got = {r.doc_id: r.kept_sha256 for r in registry.queries()["op8_quality_rules"](spark, SF).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for (i, _, _), t in zip(rows, expected)}


def test_chunk_borders_resist_shifts():
    rng = random.Random(3)
    c = ChunkConfig()
    hashes = [rng.getrandbits(64) for _ in range(300)]
    ends = chunk_ends(np.array(hashes, np.uint64), c).tolist()
    expected = [i + 1 for i in range(300) if i and (hashes[i - 1] * 0x9E3779B97F4A7C15 + hashes[i] & (1 << 64) - 1) >> 33 and ((hashes[i - 1] * 0x9E3779B97F4A7C15 + hashes[i]) % (1 << 64) >> 33) % 3 == 0]
    assert ends == sorted({*expected, 300})
    moved = chunk_ends(np.array([1, 2, 3, *hashes], np.uint64), c).tolist()
    assert [x - 3 for x in moved if x > 4] == [x for x in ends if x > 1] and 70 < len(ends) < 130
    assert chunk_ends(np.array([7], np.uint64), c).tolist() == [1]


def test_line_blocks_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for k in range(2, 8):  # blocks of k lines inside other text
        for n in range(10):
            block = [passage(rng, 8) for _ in range(k)]
            for copy in range(2):
                rows.append((len(rows), "\n".join([passage(rng, 6) for _ in range(3)] + block + [passage(rng, 6) for _ in range(3)])))
                assert copy == 0 or rows[-2][1] != rows[-1][1]
    planted = len(rows)
    rows += [(300, "a b\n\n\n\nc d"), (301, "e f\n\n\n\nc d"), (302, "g\n\n\n\nh"), (303, "\n".join(["x", "y"] * 40)), (304, "q\r\nr\r\ns"), (305, "q\r\nr\r\nt"), *ODD]
    shared = [passage(rng, 8) for _ in range(30)]
    rows += [(400 + i, "\n".join([passage(rng, 6) for _ in range(rng.randrange(5))] + shared[i % 3 :] + [passage(rng, 6) for _ in range(4)])) for i in range(20)]
    rows.append((500, "\n".join(f"{k % 700} line" for k in range(5000))))  # a long text that repeats itself
    expected = brute.line_blocks(rows)
    got = {r.doc_id: r for r in without_repeated_blocks(frame(spark, rows)).collect()}
    assert {i: r.text or "" for i, r in got.items()} == expected
    assert [got[i].n_removed_lines for i in range(planted)] == [0 if i % 2 == 0 else 2 + i // 20 for i in range(planted)]
    assert all(got[i].n_removed_blocks == i % 2 for i in range(planted)) and got[900].text is None and got[900].n_lines == 0
    same = frame(spark, [(1, rows[0][1]), (1, rows[0][1]), (None, rows[0][1])])
    assert {r.doc_id for r in repeated_blocks(same).collect()} == {1}
    assert without_repeated_blocks(frame(spark, [])).count() == 0


def test_line_hashes_that_collide_are_not_used(spark):
    rows = [(1, "alpha one\nbeta\ngamma"), (2, "alpha two\nbeta\ngamma"), (3, "x\nalpha one\nbeta"), (4, "y\nalpha two\nbeta"), (5, "z\nalpha six\nbeta"), (6, "alpha ten\nbeta")]

    def weak(line, parted):
        """All lines that begin with alpha share a hash at first, all but one of them in the second round."""
        if line.startswith(b"alpha") and len(parted) < 2:
            return 8 if len(parted) == 1 and line == b"alpha ten" else 7
        return line_hash(line, ())

    c, docs = ChunkConfig(hash=weak), frame(spark, rows)
    assert collisions(_with_ranges(docs, (), Scratch(spark, "t"), c), (), c) == frozenset({7})
    assert {r.doc_id: r.text for r in without_repeated_blocks(docs, c).collect()} == brute.line_blocks(rows)
    met = (frozenset({line_hash(b"a", ())}),)
    assert line_hash(b"a", ()) != line_hash(b"a", met) and line_hash(b"b", ()) == line_hash(b"b", met)


def test_line_chunk_query_equals_brute_force(spark):
    import hashlib

    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r.kept_sha256 for r in registry.queries()["op9_line_chunks"](spark, SF).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute.line_blocks(rows).items()}


def test_url_rules(spark):
    rng = random.Random(7)
    rules = [("allow", "com", "/"), ("block", "a.com", "/x"), ("allow", "a.com", "/x/y"), ("block", "b.a.com", "/"), ("allow", "b.a.com", "/x/y/z"), ("block", "net", "/"), (None, "org", "/"), ("block", "", "/")]
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "za.com", "A.COM", "net", "q.net", "org", "", "a.com:80", "a..com"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y', '/x/y/z?q#f', '?a', '#b'])}" for _ in range(400)] + [None, "", "a.com/x", "://", "x://y://z", "http://a.com/x"] + ["http://b.a.com/x/y/z"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.com/x")], "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: r for r in url_rules(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert len(got) == len(urls) + 1
    for i, url in enumerate(urls):
        host, path = split_url(url)
        fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if v and h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[2], best[3]), url
    assert url_rules(pages.limit(0), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0
    none = url_rules(pages, spark.createDataFrame([], "verdict string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert list(got.columns) == list(expected.columns) and len(expected) > 0
    by = list(expected.columns)
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True), expected.sort_values(by).reset_index(drop=True), check_dtype=False)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scratch = Scratch(spark, "t")
    for name, stage in p.STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, SF), "stage")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        left = {r.doc_id for r in after.collect()}
        before = {r.doc_id for r in docs.collect()}
        assert left <= before
        if name == "minhash near-dedup":
            heads = brute.components({i: brute.shingle_set(rows[i], 5) for i in before})
            assert left == set(heads.values())
        if name == "benchmark decontamination":
            items = [normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
            held = {i for i in before if any(x in normalise(rows[i]) for x in items)}
            assert not left & held and len(before - left) < len(held) + 5
        docs = after
    out = p.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as p

    names = ["score", "item_ids", "distances", "copies", "k", "p", "bins", "n_tokens", "version", "kept", "rest", "__id", "__m", "features"]
    docs = table(spark, SF, "documents").where("doc_id < 60")
    odd = frame(spark, [(100000 + i if i is not None else None, t) for i, t in [*ODD, (None, "a b"), (7, "x " * 30000)]]).select(*docs.columns)
    wide = docs.unionByName(odd).select("*", *[F.concat(F.lit(x), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(x) for x in names])
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, wide, SF)
        assert after.dtypes == wide.dtypes, name
        rows = after.collect()
        assert rows and all(r[x] == f"{x}{-1 if r.doc_id is None else r.doc_id}" for r in rows for x in names), name
        assert stage(spark, wide.limit(0), SF).count() == 0, name


def test_character_model_rows_sum_to_one(spark):
    costs = character_model(table(spark, SF, "documents"))
    assert abs(np.exp(-costs).sum(2) - 1).max() < 1e-9
    assert ToxicConfig().max_labelled == 8000
