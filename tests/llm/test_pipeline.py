"""The pipeline's stages one after the other, each written and read again, against what each must keep."""

import re

import corpus_pipeline
from quadspark.llm import decontaminate, secret_scan
from quadspark.llm.common import split_words

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        assert i == len(corpus_pipeline.STAGES) - 1 or kept[-1].columns == columns
    _, toxic, near, clean, safe, packed = kept
    text = lambda f: {r.doc_id: r.text for r in f.collect()}
    before, after = text(toxic), text(near)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() if (w := split_words(t))}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(like(a, b) < 0.8 for a in after for b in after if a < b and a in sets and b in sets)
    assert all(any(like(i, j) >= 0.8 for j in before if j != i) for i in set(before) - set(after))
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(re.search(r"(^|\s)" + re.escape(b) + r"(\s|$)", t) for b in bench)
    items = decontaminate.build_items(list(enumerate(bench)), 7)
    assert not any(holds(t) for t in text(clean).values())
    gone = [t for i, t in after.items() if i not in text(clean)]
    assert all(decontaminate.find_items([t], items, decontaminate.PlainHashes(), 0.8)[0] for t in gone)
    assert set(text(safe)) == set(text(clean)) and all(not secret_scan.base_spans(t or "") for t in text(safe).values())
    assert all(t == text(clean)[i] for i, t in list(text(safe).items())[:20] if not secret_scan.find_secrets(text(clean)[i]))
    tokens = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert tokens == {i: n for i, t in text(safe).items() if (n := len(split_words(t)))}


def test_pipeline_edges(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, bucket int, class string, label int, _least int"
    more = lambda *r: (*r, 1, "x", 2, 3)
    (item,) = (r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).collect())
    rows = [more(1, None, "en", "s", 0), more(2, "", "en", "s", 0), more(3, "a b c d e f g", "fr", "z", 13), more(3, "a b c d e f g", "en", "s", 13), more(4, "a b c d e f g", None, None, None), more(None, "lone words here", "en", "s", 15)]
    rows += [more(5, f"before {item} after", "en", "s", 1), more(6, "password=hunter2hunter2 end", "en", "s", 1), more(6, "password=hunter2hunter2 end", "en", "s", 1)]
    docs = spark.createDataFrame(rows, shape)
    text = lambda f: sorted((r.doc_id or 0, r.text or "") for r in f.collect())
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_duplicates"](spark, docs, SF)
    assert near.columns == docs.columns and [x[0] for x in text(near)] == [0, 1, 2, 3, 5, 6]
    assert [r.lang for r in near.where("doc_id = 3").collect()] == ["en"]  # the least of the repeated rows
    assert text(stages["decontamination"](spark, docs, SF)) == [x for x in text(docs) if x[0] != 5]
    safe = stages["secrets"](spark, docs, SF)
    assert safe.columns == docs.columns and [r.text for r in safe.where("doc_id = 6").collect()] == ["<ASSIGN> end"] * 2 and safe.count() == docs.count()
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns and text(kept) == text(docs)
    assert stages["packing"](spark, docs, SF).where("doc_id = 6").count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0
