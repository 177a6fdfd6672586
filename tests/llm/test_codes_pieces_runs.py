"""Vector codes, SentencePiece ids and periodic runs against plain versions of their rules."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tidemark.llm import catalog, periodic_runs, sentence_pieces, vector_codes

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# --- vector codes


def plain_codes(rows, rounds=6):
    """Full scans in Python integers. rows: (id, label, vector), all usable and of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2]) // 8
    parts = [[tuple(math.floor(4096 * x) for x in v[p * width : p * width + width]) for p in range(8)] for _, _, v in rows]
    books = [[x[p] for x in parts[:16]] for p in range(8)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            own = [nearest(x[p], books[p])[1] for x in parts]
            for k in range(len(books[p])):
                if mine := [x[p] for x, o in zip(parts, own, strict=True) if o == k]:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    found = [[nearest(x[p], books[p]) for p in range(8)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for (_, label, _), e in zip(rows, errors, strict=True):
        of_label[label] = of_label.get(label, 0) + e
    book = sha(",".join(str(c) for p in books for e in p for c in e))
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in f), e, of_label[r[1]], book) for r, f, e in zip(rows, found, errors, strict=True))


def coded(df, **how):
    return sorted((str(r.vec_id), None if r.code is None else r.code.hex(), r.error, r.label_error, r.codebooks) for r in vector_codes.vector_codes(df, **how).collect())


VECTORS = "vec_id long, embedding array<double>, label int, code2 string"


@pytest.mark.parametrize("kind", ["close", "ties", "copies", "few", "huge"])
def test_codes_equal_full_scans(spark, kind):
    rng = random.Random(kind)
    n = 9 if kind == "few" else 120
    pick = {"ties": lambda: rng.choice([0.0, 1 / 4096, -1 / 4096, 2 / 4096]), "huge": lambda: rng.choice([rng.gauss(0, 1), 3e5, -2e5])}.get(kind, lambda: rng.gauss(0, 1))
    rows = [(i, [pick() for _ in range(16)], rng.choice([None, 1, 2]), "x") for i in range(n)]
    if kind == "copies":
        rows = [(r[0], rows[r[0] % 5][1], 1, "x") for r in rows] + rows[:3] + [(None, rows[7][1], None, "x")]
    told = []
    assert coded(spark.createDataFrame(rows, VECTORS), told=told) == plain_codes([(i, label, v) for i, v, label, _ in rows])
    if kind == "close":
        assert told[0] == n * 8 and sum(told[1:]) < 5 * n * 8  # bounds spare scans


def test_codes_of_odd_and_empty_tables(spark):
    v = [0.5] * 8
    rows = [(3, v, 1, "x"), (2, None, 1, "x"), (4, [None] * 8, 1, "x"), (5, [math.nan] * 8, 1, "x"), (6, [math.inf] * 8, 1, "x"), (7, [1.0] * 9, 1, "x"), (8, [], None, "x"), (9, v, None, "x")]
    got = coded(spark.createDataFrame(rows, VECTORS))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("3", "00" * 8, 0, 0), ("7", None, None, 0), ("8", None, None, 0), ("9", "00" * 8, 0, 0)]
    assert coded(spark.createDataFrame([], VECTORS)) == []
    assert {r[1] for r in coded(spark.createDataFrame([(1, [1.0] * 7, 1, "x")], VECTORS))} == {None}
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS).withColumnRenamed("vec_id", "code"), id_col="code")


def test_bounds_hold():
    """Upper and lower bounds on both sides of the true distances through rounds of moving entries."""
    rng = np.random.default_rng(2)
    x = rng.integers(-4000, 4000, (300, 8, 3))
    books = x[:16].transpose(1, 0, 2).copy()
    state = vector_codes.assign(x, books)
    for _ in range(5):
        new = books + rng.integers(-300, 300, books.shape)
        moved = np.sqrt(((new - books) ** 2).sum(axis=2)) * (1 + 1e-9)
        state, books = vector_codes.assign(x, new, state, moved), new
        far = np.sqrt(((x[:, :, None, :] - books[None]) ** 2).sum(axis=3))
        assert (state.code == far.argmin(axis=2)).all()
        own = np.take_along_axis(far, state.code[:, :, None], 2)[:, :, 0]
        assert (state.upper >= own).all() and (state.lower <= np.sort(far, axis=2)[:, :, 1]).all()


# --- SentencePiece


ODD = ["", " ", "  ", "a", " a", "a ", "a   b", "\n\n x", "▁", "a▁▁b", "\x00a\x00", "<s></s><0x41><unk>", "日本語　テキスト", "🙂 👩‍👩‍👧 ok", "é é ñ", "x" * 300, " " * 90, "aaaaaaaaaaaaa", "don't we're", "\t\r\n", "A.B'S", "1234567890 3.14", "梦ab梦"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return sentence_pieces.PieceCoder(MODEL)


def test_pieces_equal_the_library(spark, library, own):
    rng = random.Random(1)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    made += ["".join(rng.choice("ab \n▁") for _ in range(rng.randrange(14))) for _ in range(2000)]
    made += ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x500), rng.randrange(0x4E00, 0x5000), 0x1F600])) for _ in range(rng.randrange(20))) for _ in range(2000)]
    for t in [*ODD, *texts, *made]:
        ids = own.encode(t).tolist()
        assert ids == library.encode(t)
        assert own.decode(ids) == library.decode(ids)


def test_every_prefix_is_in_the_table(library, own):
    """The table's ids of a prefix of a normalised text are those of that prefix alone."""
    for t in ["Hello worldly wise", "the   thing's", "naïve 梦 x", "aaaaaaa"]:
        text = library.normalize(t)
        table = own.prefix_table(text)
        plain = SentencePieceProcessor(model_proto=_without_prefix(library))
        for k in range(1, len(text) + 1):
            assert own.recover(table, k) == plain.encode(text[:k])


def _without_prefix(library):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    model.normalizer_spec.add_dummy_prefix = False
    return model.SerializeToString()


def test_ids_that_no_text_has_decode_as_the_library_does(library, own):
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 28705]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids)


def test_op12(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = catalog.queries()["op12_sentence_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id]) + [2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_pieces_of_odd_rows(spark, library):
    rows = [(k, t, "s", 1) for k, t in enumerate(ODD)] + [(90, None, None, None), (None, "some text", "s", 1), (91, "same", "s", 1), (91, "same", "s", 1), (92, "long word " * 30000, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, i string, t int")
    got = sorted((str(r.doc_id), r.token_ids, r.decoded) for r in sentence_pieces.encode_and_decode(df).collect())
    assert got == sorted((str(k), library.encode(t or "") + [2], library.decode(library.encode(t or ""))) for k, t, _, _ in rows)
    assert sentence_pieces.encode_and_decode(df.limit(0)).count() == 0
    back = sentence_pieces.decode_ids(spark.createDataFrame([(1, [22557, None, 1526]), (2, None)], "doc_id long, token_ids array<int>")).collect()
    assert {r.doc_id: r.decoded for r in back} == {1: library.decode([22557, 1526]), 2: None}
    with pytest.raises(ValueError):
        sentence_pieces.encode_and_decode(df.withColumnRenamed("doc_id", "decoded"), id_col="decoded")


# --- periodic runs


def plain_runs(w, least=12, times=2):
    """All maximal runs by their rule: (start, length, period), by start, then period."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(w, runs):
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    return [x for k, x in enumerate(w) if k not in gone]


def words_with_runs(rng, n, letters):
    w = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            s, p = rng.randrange(n), rng.randrange(1, 14)
            for i in range(s, min(n, s + rng.randrange(70))):
                w[i] = w[s + (i - s) % p]
    return w


@pytest.mark.parametrize(("least", "times"), [(12, 2), (6, 2), (7, 3), (2, 2)])
def test_runs_equal_the_rule(least, times):
    rng = random.Random(least)
    for k in range(400):
        w = words_with_runs(rng, rng.randrange(80), "ab" if k % 2 else "abcdefgh")
        ids = periodic_runs.word_ids([x.encode() for x in w])
        assert [tuple(r) for r in periodic_runs.all_runs(ids, least, times).tolist()] == plain_runs(w, least, times)


def test_runs_in_ranges_of_lags(monkeypatch):
    """Ranges of lags, and matrices of few rows, find what one scan finds."""
    rng = random.Random(7)
    w = words_with_runs(rng, 300, "abc")
    ids = periodic_runs.word_ids([x.encode() for x in w])
    whole = periodic_runs.runs_at(ids, 1, 151).tolist()
    parts = [r for low in range(1, 151, 11) for r in periodic_runs.runs_at(ids, low, min(low + 11, 151)).tolist()]
    monkeypatch.setattr(periodic_runs, "MATRIX", 700)
    assert sorted(whole) == sorted(parts) == sorted(periodic_runs.runs_at(ids, 1, 151).tolist())


def test_runs_of_odd_rows_and_of_long_texts(spark):
    rng = random.Random(9)
    made = [" ".join(words_with_runs(rng, rng.randrange(200), "abcd")) for _ in range(40)]
    rows = [(k, t, "x", 1) for k, t in enumerate([*made, "", " \n ", "é é " * 20, "a " * 500, "x\x0by\x0cz\x1c " * 20])] + [(900, None, "x", 1), (None, "a b " * 30, "x", 1), (None, "a b " * 30, "x", 1), (901, made[0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, low int")
    want = []
    for k, t, _, _ in rows:
        w = [x for x in (t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        want.append((str(k), len(w), r := plain_runs(w), " ".join(plain_kept(w, r))))
    for long in (1 << 16, 60):  # the second: most texts by ranges of lags
        got = periodic_runs.periodic_runs(df, long=long, cells=500, least_lags=3).collect()
        assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df.withColumnRenamed("doc_id", "runs"), id_col="runs")


def test_op13(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = catalog.queries()["op13_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    checked = 0
    for r in rows:
        w = [x.decode() for x in (docs[r.doc_id] or "").encode().split()]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            n, g, old = len(w), h // 10, list(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
        if len(w) > 500:  # the rule takes the cube of the words
            continue
        checked += 1
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        own = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *own)
        assert r.runs_sha256 == sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)) and r.collapsed_sha256 == sha(" ".join(plain_kept(w, runs)))
    assert checked > len(rows) // 2


def test_longest_run(spark):
    runs = F.expr("array(named_struct('start', 5L, 'length', 20L, 'period', 3L), named_struct('start', 2L, 'length', 20L, 'period', 9L), named_struct('start', 2L, 'length', 20L, 'period', 4L), named_struct('start', 0L, 'length', 12L, 'period', 1L))")
    assert tuple(spark.range(1).select(periodic_runs.longest(runs).alias("r")).first().r) == (2, 20, 4)
