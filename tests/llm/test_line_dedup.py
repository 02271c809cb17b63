import re

from folioflow.llm import line_dedup as L
from folioflow.llm import textkit as K


def units(text):
    """(start, stop, words) by characters, one at a time."""
    out = []
    for m in re.finditer(r"[^\n.!?]+", text):
        w = [x for x in re.finditer(r"[^\W_]+", m.group())]
        if w:
            out.append([m.start() + w[0].start(), None, tuple(x.group().lower() for x in w)])
    for a, b in zip(out, [*out[1:], [len(text)]]):
        a[1] = b[0]
    return [tuple(x) for x in out]


def brute(rows, least):
    first, gone = {}, set()
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t}):
        for a, b, w in units(t):
            if len(w) >= least and first.setdefault(w, (i, a)) != (i, a):
                gone.add((i, a, b, len(w), *first[w]))
    return gone


def test_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {tuple(r) for r in L.removed(documents).collect()} == brute(rows, 6)


def test_units_of_long_texts_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(K, "PIECE", 50)
    texts = ["Aa bb. cc dd! " * 40, "", None, "x\ny z " * 30, "tail? no"]
    u = K.units(texts)
    got = [[] for _ in texts]
    for i, a, b, n in zip(u["text"], u["start"], u["stop"], u["words"]):
        got[i].append((int(a), int(b), int(n)))
    assert got == [[(a, b, len(w)) for a, b, w in units(t or "")] for t in texts]


def test_cleaned_text_keeps_the_rest(spark):
    line = "the very same sentence stands here twice."
    d = spark.createDataFrame([(2, f"Start of it. {line} End of it."), (1, line)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in L.clean(d).collect()}
    assert got == {1: line, 2: "Start of it. End of it."}


def test_short_sentences_of_a_passage_go_with_it(spark):
    passage = "The first sentence has more than six words. Yes. No, never. Another sentence of more than six words follows. Quite so."
    rows = [(1, passage), (2, f"Here it is told again by us. {passage} And so it ends for all of us. Yes."), (3, "Yes. No, never. A sentence of its own with enough words. Quite so.")]
    got = {r.doc_id: r.text for r in L.clean(spark.createDataFrame(rows, "doc_id bigint, text string"), find=L.removed_passages).collect()}
    assert got == {1: passage, 2: "Here it is told again by us. And so it ends for all of us. Yes.", 3: rows[2][1]}


def test_passages_hold_all_that_removed_holds(documents):
    spans = lambda df: {(r.doc_id, r.start, r.stop) for r in df.collect()}
    short, whole = spans(L.removed(documents)), L.removed_passages(documents)
    assert short < spans(whole) and whole.where("n_words < 6").count() == len(spans(whole) - short)


def test_odd_rows(odd_docs, no_docs):
    rows = L.removed(odd_docs).collect()
    assert {r.doc_id for r in rows} <= {2}
    out = L.clean(odd_docs)
    assert out.schema.names == odd_docs.schema.names and out.count() == odd_docs.count()
    assert L.removed(no_docs).count() == 0 and L.clean(no_docs).count() == 0
    assert [r.text for r in out.where("doc_id = 7").collect()] == ["One short line only.\nOne short line only."]
