import corpus_pipeline
from loomdex.llm import bpe, decontam, golay_simhash, secrets
from loomdex.llm.queries import vocabulary

VOCABULARY = vocabulary()


def test_stages_one_by_one(spark, sf_dir):
    """Each stage against a plain reading of its rule, on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    found = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
        found.append(rows)
    kept, single, clean, red = found
    fp = {d: golay_simhash.fingerprint(r.text) for d, r in kept.items()}
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2
    left, groups = set(fp), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in left - group if near(x, y)]
        left -= group
        groups.append(min(group))
    assert set(single) == set(groups)
    items = [decontam.shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, r in single.items() if not any(len(s & decontam.shingles(r.text)) >= 0.8 * len(s) for s in items)}
    spans = {r.doc_id: r.spans for r in secrets.secret_scan(spark.createDataFrame(list(clean.values()), docs.schema)).collect()}
    assert set(red) == set(clean)
    for d, r in red.items():
        assert (r.text != clean[d].text) == bool(spans[d]) and r.n_chars == len(r.text)
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    mine = bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())
    assert {d: r.n_tokens for d, r in out.items()} == {d: len(mine.encode(r.text)) for d, r in red.items()}
    whole = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {(d, r.ids_sha256) for d, r in out.items()}


def test_odd_rows(spark, odd, tmp_path):
    """Nulls, repeated rows and clashing columns pass through all stages."""
    path = f"file://{tmp_path}"
    odd.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (9, 1, 0), (10, 1, 0), (11, 0, 0), (None, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is there at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() > 0
