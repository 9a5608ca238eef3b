"""The whole pipeline against one pass of plain Python per stage."""

import re
from collections import Counter

import numpy as np
import pytest
from test_dedup import brute, edited, line_brute

import corpus_pipeline
from tidemark.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_failed(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words) < 20 or 100 * len(again) > 30 * len(words)


def documents(rng):
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(12)
    texts = ["\n".join([prose(40), shared, prose(rng.randrange(10, 60))]) for _ in range(25)]
    texts += [texts[3], texts[4] + "\n" + prose(4), edited(rng, texts[7].split(), 1), texts[9].replace("w1", "W1")]
    texts += ["\n".join([prose(30), shared + "s", "x", "y"]), prose(5), "", None, " ".join([prose(8)] * 6), "é日本 <|endoftext|> " + prose(50), prose(3000)]
    rows = [(2 * i, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def by_hand(spark, rows, plain):
    rows = [r for r in rows if not base_failed(r[1])]
    gone = {key for key, keeper in line_brute([(r[0], r[1]) for r in rows], 0).items() if keeper is not None}
    texts = {r[0]: "\n".join(x for n, x in enumerate(r[1].split("\n")) if (r[0], n) not in gone) for r in rows}
    rows = [(r[0], texts[r[0]], *r[2:4], len(texts[r[0]])) for r in rows]
    roots = brute([(r[0], r[1]) for r in rows], 5)
    rows = [r for r in rows if roots[r[0]] == r[0]]
    times = {r["doc_id"]: r["times"] for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    coded = {r[0]: (plain.encode(r[1], add_special_tokens=False).ids, r[1]) for r in rows}
    return Counter((i, tuple(coded[i][0]), coded[i][1]) for i, n in times.items() for _ in range(n or 0))


@pytest.mark.parametrize("parts", [1, 5])
def test_pipeline_by_brute_force(spark, rng, tmp_path, vocabulary, parts):
    from tokenizers import Tokenizer

    rows = documents(rng)
    spark.createDataFrame(rows, DOCS).repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(vocabulary)
    plain.no_truncation()
    plain.no_padding()
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["text"]) for r in got) == by_hand(spark, rows, plain)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got) and len(got) > 15
