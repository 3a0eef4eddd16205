"""The pipeline against a brute-force version, stage by stage, on a small corpus."""

import random

import corpus_pipeline
from gridlake.llm import queries
from tests.llm.test_jaccard import brute


def corpus():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    line = "a licence line that very many documents of this corpus repeat word for word"
    items = [(k, " ".join(word() for _ in range(25))) for k in range(4)]
    docs = []
    for k in range(40):
        body = "\n".join(" ".join(word() for _ in range(12)) for _ in range(8))
        docs.append((k, f"{body}\n{line}" if k % 2 else body))
    docs += [(100 + k, docs[k][1] + " tail") for k in range(6)] + [(200, "too short"), (201, None), (202, " ".join(["same words here"] * 40))]
    docs += [(300 + k, docs[k + 10][1] + "\n" + t) for k, t in items]
    return [(d, t, "en", "s", len(t or "")) for d, t in docs], items


def test_pipeline(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "best-fit packing":
            assert out.columns == frame.columns
            out.write.parquet(str(tmp_path / name))
            frame = spark.read.parquet(str(tmp_path / name))
            seen[name] = {r.doc_id: r.text for r in frame.collect()}
            assert all(r.n_chars == len(r.text) for r in frame.collect())
        else:
            seen[name] = out.collect()
    first = seen["quality rules"]
    assert set(first) == {d for d, *_ in docs} - {200, 201, 202}
    second = seen["line dedup"]
    line = docs[1][1].split("\n")[-1]
    assert [d for d, t in second.items() if line in t.split("\n")] == [max(d for d, t in first.items() if line in t.split("\n"))]
    third = seen["n-gram Jaccard join"]
    assert set(third) == {d for d, _, c in brute(sorted(second.items())) if d == c}
    assert set(seen["benchmark decontamination"]) == {d for d, t in third.items() if not any(i in t for _, i in items)}
    assert {r.doc_id for r in seen["best-fit packing"]} == set(seen["benchmark decontamination"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)
    assert pieces(whole) == pieces(seen["best-fit packing"])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
