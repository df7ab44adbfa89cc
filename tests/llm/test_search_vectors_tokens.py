"""Lexical search, whitening and token files against SQL, brute force, the library and round trips."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabletrust.llm import languages, lexical, queries, tokenbin, whitening

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("byte_bpe_50k.json")


def plain(frame):
    c = sorted(frame.columns)
    return sorted(frame[c].astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(want)


def brute_search(docs, items, k):
    """docs: (doc_id, text); items: (item_id, text)."""
    import math
    import re
    from collections import Counter

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    held = [(i, Counter(found(t))) for i, t in docs if found(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(found(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_op11_odd_rows_copies_and_blocks(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "Ünï", "The", "THE", "a1-b2", "🙂x"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))) for i in range(150)]
    docs += [(1000 + i, "copy of w1 w2 w3 The text") for i in range(200)] + [(None, "w1 w2"), (None, "w1 w2"), (7, "w9 w9"), (7, "w9 w9"), (8, None), (9, ""), (10, " .,-\n"), (11, "w5 " * 3000)]
    items = [(1, "w1 w2 w3 the"), (2, "É ünï w9"), (2, "w40 w41"), (3, None), (4, "..."), (None, "W5 w6"), (5, "none such"), (6, "w1 w2 w3 the"), (6, "w1 w2 w3 the")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, k1 string, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, q string")
    want = brute_search(docs, list(dict.fromkeys((i, t) for i, t in items if t)), 5)
    assert rows_of(lexical.search(df, asked, 5)) == want
    monkeypatch.setattr(lexical, "ITEM_BYTES", 100)  # several blocks
    assert len(list(lexical.item_blocks(asked))) > 1
    assert rows_of(lexical.search(df, asked, 5)) == want
    for x in (lexical.search(df.limit(0), asked), lexical.search(df, asked.limit(0))):
        assert x.collect() == [] and x.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_joins_no_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "bounded", lambda df: df)
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(40)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = lexical.search(df, spark.createDataFrame([(0, "w1 w2"), (1, "w3 x")], "item_id int, text string"), 3)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)



def test_op11_bounds_hold():
    r = random.Random(3)
    words = [f"t{i}".encode() for i in range(400)]
    texts = [[r.choice(words[: r.randrange(2, 400)]) for _ in range(r.randrange(1, 900))] for _ in range(60)]
    counts = [{w: t.count(w) for w in set(t)} for t in texts]
    of = [sorted(r.sample(range(400), 30)) for _ in range(7)]
    block = lexical.Asked(list(range(7)), words, lexical.hashed(words), np.arange(400) * 7, of, 60, sum(map(len, texts)))
    bound = lexical.bounds(block, [len(t) for t in texts], [lexical.sketch(c).tobytes() for c in counts])
    exact = np.array([[sum(p * 7 * lexical.share(c[words[p]], block.long(len(t))) for p in o if words[p] in c) for o in of] for t, c in zip(texts, counts, strict=True)])
    assert (bound >= exact).all() and (bound == exact).mean() > 0.5


def test_op12_equals_eigenvectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    out, p = queries.op12_whitening(spark, SF).toPandas(), df.toPandas()
    x = np.floor(1024 * np.stack(p.embedding).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    assert len(out) == 8 * n and set(out.n) == {n} and out.identity_error.max() < 1e-9
    assert dict(zip(out.vec_id, out.deviation, strict=True)) == dict(zip(p.vec_id, ((n * x - s) ** 2).sum(1), strict=True))
    for k in range(8):
        own = out[out.component == k + 1].set_index("vec_id").reindex(p.vec_id)
        z = c @ q[:, -1 - k] / np.sqrt(e[-1 - k])
        assert np.abs(own.whitened.to_numpy() * np.sign(own.whitened @ z) - z).max() < 1e-8
        assert np.allclose(own.explained, e[-1 - k] / e.sum(), rtol=1e-10)


def test_op12_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, x string, n string, _id string"
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, []), (5, [1.0]), (None, [1.0, 2.0]), (6, [2.0, 2.5]), (6, [2.0, 2.5]), (7, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y", None) for r in rows], kind)
    out = whitening.whitened(df).collect()
    assert sorted({str(r.vec_id) for r in out}) == ["6", "7", "None"] and {r.n for r in out} == {4}
    out = whitening.whitened(df.where("vec_id is null or vec_id = 6")).collect()
    a, b = 100_000 + 1024, 100_000 + 2048
    sums = (a + 2 * b, b + 2 * (b + 512))
    want = {None: (3 * a - sums[0]) ** 2 + (3 * b - sums[1]) ** 2, 6: (3 * b - sums[0]) ** 2 + (3 * (b + 512) - sums[1]) ** 2}
    assert {r.vec_id: int(r.deviation) for r in out} == want and {r.component for r in out} == {1} and len(out) == 3
    for few in (df.limit(0), df.where("vec_id < 4"), df.where("vec_id = 5"), df.where("vec_id = 6")):  # none, none left, one row, equal rows
        assert whitening.whitened(few).collect() == []


def test_op12_equal_deviations_and_closed_subspaces(spark):
    r = np.random.default_rng(1)
    low = np.vstack([np.eye(6), -np.eye(6)]) @ r.normal(size=(6, 12))
    for x, k in ((np.vstack([np.eye(10), -np.eye(10)]), 8), (low, 6), (np.outer(np.arange(5.0), np.ones(4)), 1)):
        out = whitening.whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
        whole = np.floor(1024 * x)
        e = np.linalg.eigvalsh(np.cov(whole.T, bias=True))[::-1]
        got = out.groupby("component").explained.first().to_numpy()
        assert len(got) >= k and np.allclose(got, e[: len(got)] / e.sum(), rtol=1e-6) and out.identity_error.max() < 1e-4


def test_op8_samples_some_of_any_size():
    for size in (1, 3000, 10**9, 4 * 10**9, 10**13):
        share = languages.share_of(3000, size) / languages.PARTS
        assert share > 0 and (size <= 3000 or abs(share * size - 3000) < 20)


def fuzz(n):
    r = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "　", "é", "1", "23", "'s", "'", "<|endoftext|>", "!", "漢", "word", "\r\n", "🙂", "\x00", "​", "\x85", "²", "ǅ"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(n)]


def test_op13_encoder_equals_library():
    t, e, texts = Tokenizer.from_file(MODEL), tokenbin.encoder(MODEL), fuzz(20_000)
    got = e.encode(texts)
    assert [np.frombuffer(x, e.code).tolist() for x in got] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_op13_remembers_cuts_once_and_bounds_parts(monkeypatch):
    e = tokenbin.Encoder(MODEL)
    stems = ["w" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(5_000)]
    texts = [" ".join(["x", *(s + sign for s in stems)]) for sign in (",", ".", "!")] * 3
    want = [x.ids for x in Tokenizer.from_file(MODEL).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(e.encode([t])[0], e.code).tolist() for t in texts] == want
    held = [m for m in vars(e).values() if isinstance(m, tokenbin.Memory)]
    assert sum(len(m.now) + len(m.before) for m in held) <= len(stems)  # not once for each sign that follows
    monkeypatch.setattr(tokenbin, "PART_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 40, None, "b" * 60, "c" * 500, "", None, "d"])], names=["doc_id", "text"])
    assert [p.column(0).to_pylist() for p in tokenbin.parts(batch.slice(1))] == [[1, 2], [3], [4, 5, 6]]
    assert [p.column(0).to_pylist() for p in tokenbin.parts(batch)] == [[0, 1, 2], [3], [4, 5, 6]]


def test_op13_writer_encodes_texts(spark):
    rows = [(1, "one two, three"), (2, None), (3, "end <|endoftext|> of"), (4, "a  b")]
    spark.dataSource.register(tokenbin.TokenSource)
    for end in (2, None):
        folder = tokenbin.new_folder(spark)
        out = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.format("tokenbin").option("bits", 16).option("model", MODEL)
        (out if end is None else out.option("end", end)).mode("append").save(folder)
        got = [np.frombuffer(r.ids, "<u4").tolist() for r in tokenbin.read(spark, folder).orderBy("doc_id").collect()]
        t = Tokenizer.from_file(MODEL)
        assert got == [[*t.encode(x or "", add_special_tokens=False).ids, *([] if end is None else [end])] for _, x in rows]


def test_op13_packing():
    r = np.random.default_rng(0)
    for bits in range(1, 33):
        for n in (0, 1, 7, 8, 9, 1001):
            ids = r.integers(0, 1 << bits, n, np.uint64).astype(np.uint32)
            data = tokenbin.pack(ids, bits)
            assert len(data) == -(-n * bits // 8) and (tokenbin.unpack(data, n, bits) == ids).all()
    assert [tokenbin.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def expected(docs):
    t, out, start = Tokenizer.from_file(MODEL), [], 0
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op13_equals_library(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in queries.op13_token_binary(spark, SF).collect()) == expected(docs)


def test_op13_files_windows_and_odd_rows(spark, monkeypatch):
    rows = [(9, "last"), (1, None), (2, ""), (None, "no id"), (5, "one  two"), (5, "one  two"), (5, "other"), (3, "x" * 70_000 + " long"), (4, " \n ")]
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, ids string, start int").repartition(4)
    monkeypatch.setattr(tokenbin, "BLOCK", 8)
    folder = tokenbin.new_folder(spark)
    tokenbin.write(df, folder, MODEL, 2)
    got = sorted(tokenbin.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 5, 9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    of = {zlib.crc32(bytes(r.ids)) for r in got}
    assert of == {x[3] for x in expected(rows)}
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    store = tokenbin.TokenStore(folder)
    assert store.n_ids == len(whole) and all((store.document(k) == np.frombuffer(r.ids, "<u4")).all() for k, r in enumerate(got))
    for a, n in ((0, 5), (3, 40), (len(whole) - 3, 10), (0, len(whole)), (len(whole), 4)):
        assert (store.window(a, n) == whole[a : a + n]).all()
    windows = sorted(tokenbin.read(spark, folder, 64).collect())
    assert [r.start for r in windows] == list(range(0, len(whole), 64)) and np.concatenate([r.ids for r in windows]).tolist() == whole.tolist()
    empty = tokenbin.new_folder(spark)
    tokenbin.write(df.limit(0), empty, MODEL, 2)
    assert tokenbin.read(spark, empty).count() == 0
    with pytest.raises(Exception, match="manifest"):
        tokenbin.read(spark, tokenbin.new_folder(spark)).count()



def test_folded_sketches_and_packed_texts_come_back():
    for n in (1, 3, 50, 3000):
        made = lexical.sketch({f"w{i}".encode(): i % 300 + 1 for i in range(n)})
        assert lexical.unfolded(lexical.folded(made)) == made.tobytes() and (n < 50 or len(lexical.folded(made)) < len(made) // 2)
    assert lexical.unpacked(lexical.packed("a É 🙂\n")) == "a É 🙂\n"
