"""Encoders, token files, the range coder, mixing, the pipeline."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import bpe, lines, mixing, near_dup, quality, rangecoder, token_files
from tidemark.llm.tokens import decoder, encoder

SMALL = "/root/testdata/sf0.001"
ALPHABET = " \n\t\u00a0\u2003ab'st<|>endoftx.,1é\u0250日\U0001f642\x1c"


@pytest.fixture(scope="module")
def plain(vocabulary):
    return Tokenizer.from_file(vocabulary)


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=4))
def test_words_give_the_ids_of_the_text(texts):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = encoder(path)
    ids, at = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == own.plain(texts)
    raw, cut = decoder(path).bytes_of(ids, at)
    assert [raw.tobytes()[a:b].decode() for a, b in zip(cut[:-1], cut[1:], strict=True)] == texts


def test_memory_is_thinned(vocabulary, monkeypatch):
    """Units beyond the memory: the ones met more often stay, and ids stay right."""
    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    own = tokens.Encoder(vocabulary)
    rng = np.random.default_rng(12)
    common = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(60)]
    for _ in range(12):
        texts = [" ".join(common + ["".join(rng.choice(list("hijklmnop"), 7)) for _ in range(60)]) for _ in range(2)]
        ids, at = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == own.plain(texts)
        assert own._count <= 300 + 250
    kept = own._count
    own.encode([" ".join(common)])
    assert own._count <= kept + 1  # the first word, which has no blank before it


def test_special_token_is_one_id(vocabulary):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|"]
    own = encoder(vocabulary)
    ids, at = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == own.plain(texts)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_chunks_give_the_ids_of_the_text(data):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = data.draw(st.lists(st.text(alphabet=ALPHABET, min_size=20, max_size=300), min_size=1, max_size=4))
    texts = data.draw(st.lists(st.lists(st.sampled_from(pieces), max_size=6).map("".join), min_size=1, max_size=4))
    own = bpe.coder(path)
    raw = b"".join(t.encode() for t in texts)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, at = own.encode(np.frombuffer(raw, np.uint8), offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == own.enc.plain(texts)


def test_shared_chunks_are_encoded_once(vocabulary):
    rng = np.random.default_rng(1)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000))
    own = bpe.ChunkCoder(encoder(vocabulary), decoder(vocabulary))
    texts = [passage, "other start " + passage, passage[5000:] + " end"]
    raw = b"".join(t.encode() for t in texts)
    own.encode(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
    assert own.reused > 1.5 * own.encoded


def test_round_trip_query(spark, plain, odd, wide, empty, vocabulary):
    import hashlib

    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in bpe.encode_decode(wide, vocabulary).collect()]
    want = [(r["doc_id"], ids := ids_of(plain, r["text"]), plain.decode(ids, skip_special_tokens=False)) for r in odd.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert bpe.encode_decode(empty, vocabulary).count() == 0 and bpe.encode_decode(odd, vocabulary).count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in entry.queries()["op6_bpe_round_trip"](spark, SMALL).collect():
        ids = ids_of(plain, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# the range coder


def round_trip(blocks, lanes=2048):
    prior, words = rangecoder.encode(blocks, lanes)
    prior = rangecoder.Prior.from_bytes(prior.to_bytes())
    back = rangecoder.decode(prior, words, np.array([len(b) for b in blocks], np.int64), lanes)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    return words


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**32 - 1)), max_size=150), max_size=5), st.integers(1, 3))
def test_range_coder_round_trip(blocks, lanes):
    round_trip([np.array(b, np.uint32) for b in blocks], lanes)


def test_range_coder_takes_large_alphabets():
    rng = np.random.default_rng(6)
    round_trip([rng.permutation(300_000)[i : i + 1024].astype(np.uint32) for i in range(0, 300_000, 1024)])


def test_a_document_of_a_million_different_ids(monkeypatch):
    """A segment with more ids than a prior takes goes in chapters; so does one of few ids beside it."""
    segment = token_files.Segment(9)
    ids = np.random.default_rng(3).permutation(1_000_000).astype(np.uint32) * np.uint32(4111) + np.uint32(7)
    segment.add([1, None], [1_000_000, 0], ids)
    payload = token_files.pack(segment)
    assert np.frombuffer(payload, "<u4", 4, 4)[3] == 2
    back = token_files.unpack(payload)
    assert (back.before, back.doc_ids, back.sizes) == (9, [1, None], [1_000_000, 0]) and np.array_equal(back.flat(), ids)
    monkeypatch.setattr(rangecoder, "MOST_IDS", 8)
    monkeypatch.setattr(token_files, "BLOCK", 4)
    monkeypatch.setattr(token_files, "CHAPTER", 2)
    for n in (0, 3, 8, 9, 30):
        small = token_files.Segment(0)
        small.add([5], [n], np.arange(n, dtype=np.uint32) * np.uint32(1 << 27))
        assert np.array_equal(token_files.unpack(token_files.pack(small)).flat(), small.flat())


def test_range_coder_learns():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 50_000, 40)
    repeated, noise = np.tile(phrase, 100).astype(np.uint32), rng.integers(0, 50_000, 4000).astype(np.uint32)
    few = (rng.geometric(0.02, 4000) % 65535).astype(np.uint32)
    a, b, c = (2 * len(round_trip([x])[0]) for x in (repeated, noise, few))  # 16-bit words
    assert a < 0.08 * 4000 and c < 0.55 * 4000 and b < 0.9 * 4000


def test_range_coder_beats_a_dictionary_coder(vocabulary, spark):
    """On the given documents, block by block: fewer bits an id than zlib at its best, prior included."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids, _ = encoder(vocabulary).encode(texts)
    blocks = [ids[i : i + token_files.BLOCK] for i in range(0, len(ids), token_files.BLOCK)]
    prior, words = rangecoder.encode(blocks)
    own = 4 * sum(map(len, words)) + len(prior.to_bytes())
    assert own < 0.85 * sum(len(zlib.compress(b.astype(np.uint16).tobytes(), 9)) for b in blocks)


def test_blocks_are_coded_alone():
    """A block's words follow from the prior and the block."""
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 300, n).astype(np.uint32) for n in (500, 70, 500)]
    prior, together = rangecoder.encode(blocks)
    assert all(np.array_equal(rangecoder.Blocks([b], prior).words()[0], w) for b, w in zip(blocks, together, strict=True))
    assert all(np.array_equal(rangecoder.decode(prior, [w], np.array([len(b)]))[0], b) for b, w in zip(blocks, together, strict=True))


def test_files(spark, plain, odd, wide, empty, vocabulary, tmp_path, monkeypatch):
    token_files.write(wide, str(tmp_path / "f"), vocabulary, parts=3)
    got = token_files.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    rows = [(r["doc_id"], [*ids_of(plain, r["text"]), 2]) for r in odd.collect()]
    assert sorted(map(str, rows)) == sorted(str((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    monkeypatch.setattr(token_files, "PART_CUTS", 0)  # ranges by Spark's sample
    token_files.write(wide, str(tmp_path / "s"), vocabulary, parts=3)
    again = token_files.read(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["ids"]) for r in again] == [(r["doc_id"], r["start"], r["ids"]) for r in got]
    monkeypatch.undo()
    for parts in (1, 40):
        token_files.write(odd, str(tmp_path / f"p{parts}"), vocabulary, parts=parts)
        assert [r["ids"] for r in token_files.read(spark, str(tmp_path / f"p{parts}")).orderBy("start").collect()] == [r["ids"] for r in got]
    token_files.write(empty, str(tmp_path / "e"), vocabulary)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_damage_is_found():
    segment = token_files.Segment(5)
    segment.add([3, None], [5000, 1], np.append(np.arange(5000), 2**32 - 1).astype(np.uint32))
    payload = token_files.pack(segment)
    back = token_files.unpack(payload)
    assert (back.before, back.doc_ids, back.sizes) == (5, [3, None], [5000, 1]) and back.flat().tolist() == segment.flat().tolist()
    for at in (len(payload) // 2, len(payload) - 400, 170):
        broken = bytearray(payload)
        broken[at] ^= 1
        with pytest.raises(token_files.CorruptFile):
            token_files.unpack(bytes(broken))
        body = bytes(broken[:-4])
        with pytest.raises(token_files.CorruptFile):
            token_files.unpack(body + zlib.crc32(body).to_bytes(4, "little"))


def test_ids_of_any_size(spark, tmp_path, vocabulary):
    """An end id above 16 bits comes back whole; one above 32 bits is refused."""
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    token_files.write(docs, str(tmp_path / "w"), vocabulary, end_id=70_000)
    ends = [np.frombuffer(r["ids"], "<u4")[-1] for r in token_files.read(spark, str(tmp_path / "w")).collect()]
    assert ends == [70_000, 70_000]
    with pytest.raises(ValueError):
        token_files.write(docs, str(tmp_path / "x"), vocabulary, end_id=1 << 32)


def test_long_text_is_coded_in_parts(plain, vocabulary, monkeypatch):
    """A text of many pieces has the ids of the whole text."""
    from tidemark.llm import tokens

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeé 日"), rng.integers(1, 9))) for _ in range(500)]
    text = "".join(rng.choice(words) + str(rng.choice([" ", "  ", ". ", ".\n", "\n\n", "!"])) for _ in range(20_000))
    whole = ids_of(plain, text)
    monkeypatch.setattr(tokens, "PIECE", 5000)
    monkeypatch.setattr(bpe, "PIECE", 5000)
    raw = np.frombuffer(text.encode(), np.uint8)
    assert encoder(vocabulary).encode([text, "a", ""])[0].tolist() == whole + ids_of(plain, "a")
    ids, at = bpe.coder(vocabulary).encode(raw, np.array([0, 0, len(raw)]))
    assert ids.tolist() == whole and at.tolist() == [0, 0, len(whole)]


def test_token_files_query(spark, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    start = 0
    for r in entry.queries()["op2_token_files"](spark, SMALL).orderBy("doc_id").collect():
        ids = [*ids_of(plain, texts[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# mixing


def fill(sizes, weights, share=1.5, cap=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in capped]
        rest = budget - sum(capped.values())
        shares = {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if shares[n] > cap * sizes[n]]
        if not over:
            return capped | shares
        capped |= {n: cap * sizes[n] for n in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_resharing(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {(None if i == 3 else f"s{i}"): int(rng.integers(0, 2000)) for i in range(9)}
    table = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    assert got == pytest.approx(fill(sizes, mixing.WEIGHTS))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), min_size=1, max_size=7), st.integers(0, 400))
def test_fit_is_the_best_sum(table, budget):
    lengths, counts = np.array(list(table), np.int64), np.array(list(table.values()), np.int64)
    reach = {0}
    for length, count in table.items():
        reach = {r + length * i for r in reach for i in range(count + 1)}
    take = mixing._knapsack(lengths, counts, budget)
    assert (take <= counts).all() and int((take * lengths).sum()) == max(r for r in reach if r <= budget)
    near = mixing.fit(lengths, counts, budget)
    assert (0 <= near).all() and (near <= counts).all() and int((near * lengths).sum()) <= budget


def test_fit_takes_short_and_long_alike():
    """Lengths 1 to 3,000, three documents each, 30 %: each third of the lengths gives its share of documents."""
    lengths, counts = np.arange(1, 3001), np.full(3000, 3)
    budget = int(0.3 * (lengths * counts).sum())
    take = mixing.fit(lengths, counts, budget)
    assert int((take * lengths).sum()) == budget
    shares = [take[i : i + 1000].sum() / 3000 for i in (0, 1000, 2000)]
    assert max(shares) - min(shares) < 0.05 and all(abs(s - 0.3) < 0.05 for s in shares)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 10_000), st.integers(1, 400), min_size=1, max_size=40), st.floats(0.01, 0.99))
def test_fit_keeps_proportions(table, share):
    """No length is more than a document away from its share, but for what the knapsack adds to close the gap."""
    lengths, counts = np.array(list(table), np.int64), np.array(list(table.values()), np.int64)
    budget = int(share * (lengths * counts).sum())
    take = mixing.fit(lengths, counts, budget)
    over = take - np.ceil(counts * share)
    assert int((take * lengths).sum()) <= budget and (take >= np.floor(counts * (budget / (lengths * counts).sum())) - 1).all()
    assert (np.maximum(over, 0) * lengths).sum() <= (mixing.ROOM + 1) * lengths.max()


def test_mix_reaches_targets_and_repeats_itself(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [sorted(map(tuple, mixing.mix(df).collect())) for df in (docs, docs.repartition(11))]
    assert rows[0] == rows[1]
    found = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (found.taken <= 2 * found["size"]).all()
    for _, own in found.groupby("source"):
        assert own.target.iloc[0] - own.taken.sum() < 60 and own.taken.sum() <= own.target.iloc[0] + 1e-6


def test_hot_length_is_taken_in_part(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'a b c' as text", "if(id < 4000, 'x', 'y') as source")
    found = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(0 <= r["g"] - r["t"] < 3 for r in found)


def test_mix_of_odd_tables(odd, empty, wide):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    out = mixing.repeat_rows(wide)
    assert out.columns == wide.columns
    assert mixing.repeat_rows(empty).count() == 0


def test_rows_without_an_id_are_taken_as_the_mix_says(spark):
    rows = [(None, " ".join(["w"] * (1 + i % 9)) + f" {i % 40}", "ab"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = sorted(r["t"] for r in mixing.mix(docs).groupBy("target").agg(F.sum("taken").alias("t")).collect())
    got = sorted(r["t"] for r in mixing.sizes(mixing.repeat_rows(docs)).groupBy("source").agg(F.sum("size").alias("t")).collect())
    assert got == want


def test_rows_of_one_id_are_taken_as_the_mix_says(spark):
    """One id for rows of several sources and lengths, some of them equal: words by source are those of the mix."""
    rows = [(i % 3, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2]) for i in range(90)] + [(5, "x y z", s) for s in "aaabbb"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = [r["t"] for r in mixing.mix(docs).groupBy("target").agg(F.sum("taken").alias("t")).collect()]
    got = [r["t"] for r in mixing.sizes(mixing.repeat_rows(docs)).groupBy("source").agg(F.sum("size").alias("t")).collect()]
    assert len(want) == 2 and sorted(got) == sorted(want)


# the pipeline


def test_stages_keep_the_columns_and_agree_with_their_operators(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stage(spark, docs, SMALL).toPandas()
        if name != "token ids":
            assert list(seen[name].columns) == columns
            before, docs = docs, spark.createDataFrame(seen[name], docs.schema)
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.judge(before, spark.read.parquet(f"{SMALL}/labels.parquet")).where("kept").collect()}
            assert set(seen[name].doc_id) == kept
        elif name == "line dedup":
            rows = lines.judge(before).where("kept").groupBy("doc_id").count().collect()
            left = {i: sum(1 for x in t.split("\n") if x.strip()) for i, t in zip(seen[name].doc_id, seen[name].text, strict=True)}
            assert {r["doc_id"]: r["count"] for r in rows} == {i: n for i, n in left.items() if n}
            assert len(seen[name]) == before.count()
        elif name == "near dedup":
            kept = {r["doc_id"] for r in near_dup.groups(before, k=5).where("kept").collect()}
            assert set(seen[name].doc_id) == kept and seen[name].doc_id.is_unique
        elif name == "source mix":
            times = {r["doc_id"]: r["times"] for r in mixing.mix(before).collect() if r["times"]}
            assert seen[name].doc_id.value_counts().to_dict() == times
    texts = dict(zip(seen["source mix"].doc_id, seen["source mix"].text, strict=True))
    for i, ids, text in zip(seen["token ids"].doc_id, seen["token ids"].ids, seen["token ids"].text, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(plain, texts[i]) and text == texts[i]
    assert len(seen["token ids"]) == len(seen["source mix"]) == corpus_pipeline.run(spark, SMALL).count()


def test_only_texts_with_a_special_token_leave_the_chunks(plain, vocabulary, rng):
    """Texts beside one that names a special token are cut into chunks all the same."""
    coder = bpe.ChunkCoder(encoder(vocabulary), bpe.decoder(vocabulary))
    prose = [" ".join(rng.choice(["alpha", "beta", "Gamma,", "delta.", "epsilon"]) + str(rng.randrange(99)) for _ in range(n)) for n in (900, 0, 1, 1500)]
    for at in range(5):
        texts = [*prose[:at], "a <|endoftext|> b", *prose[at:], "<|endoftext|>"]
        raw = [t.encode() for t in texts]
        before = coder.encoded + coder.reused
        ids, cut = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [ids_of(plain, t) for t in texts]
        assert coder.encoded + coder.reused > before
