import corpus_pipeline as P
from folioflow.llm import packing, pii, quality_classifier, simhash
from folioflow.llm.line_dedup import cut_spans

from .test_line_dedup import brute as repeated
from .test_packing import brute as packed
from .test_simhash import border_copies, brute_groups


def test_run_against_brute_force(spark, sf, documents, labels):
    rows = {r.doc_id: r.text for r in documents.collect()}
    w = quality_classifier.fit(documents, labels)
    score, _ = quality_classifier.score_texts(list(rows.values()), w, 18)
    rows = {i: t for (i, t), s in zip(rows.items(), score) if round(float(s), 6) >= quality_classifier.Params().threshold}
    for g in brute_groups(list(rows.items()), simhash.Params()):
        for i in sorted(g)[1:]:
            rows.pop(i)
    spans = {}
    for i, a, b, *_ in repeated(list(rows.items()), 6):
        spans.setdefault(i, []).append((a, b))
    rows = {i: cut_spans(t, *zip(*spans[i])) if i in spans else t for i, t in rows.items()}
    m, p = pii.train(), pii.Params()
    rows = {i: pii.mask(t, pii.spans_of(*pii.label_texts([t], m, p), p.min_length)[0]) for i, t in rows.items()}
    capacity = packing.Params().capacity
    pieces = sorted((-min(capacity, n - k * capacity), i, k) for i, t in rows.items() for n in [len(t.encode()) + 1] for k in range(-(-n // capacity)))
    want = {(i, k, -n, *b) for (n, i, k), b in zip(pieces, packed([-n for n, *_ in pieces], capacity))}
    got = {(r.doc_id, r.piece, r.n_tokens, r.bin, r.bin_offset) for r in P.run(spark, sf).collect()}
    assert got == want


def test_near_copies_at_the_radius_go(spark, sf):
    rows = border_copies()
    gone = {i for g in brute_groups(rows, simhash.Params()) for i in sorted(g)[1:]}
    kept = P.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf)
    assert len(gone) > 50 and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows if i not in gone]


def test_stages_keep_columns_and_take_odd_rows(spark, sf, odd_docs, no_docs):
    names = [name for name, _ in P.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]
    for docs in (odd_docs, no_docs):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, sf)
            if i < 4:
                assert out.schema.names == docs.schema.names
            docs = out
        docs.collect()
