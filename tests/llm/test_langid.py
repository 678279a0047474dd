from __future__ import annotations

import numpy as np
import pytest

from periodica.llm import langid
from periodica.llm.common import held_out


@pytest.fixture(scope="module")
def known(documents):
    return langid.learn(documents, ~held_out("doc_id"))


def test_held_out_documents(documents, known):
    found = langid.predict(documents, known).join(documents, "doc_id").where(held_out("doc_id"))
    rows = found.select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_filter_holds_every_learnt_trigram():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 62, 3000)
    langs = ["a"] * 1500 + ["b"] * 1500
    table = pa.table({"lang": langs, "gram": pa.array(grams)})
    known = langid._filter(table, langid.Learning(digits=14, probes=2))
    masks = known.masks(grams.view(np.uint64))
    assert (masks[:1500] & 1).all() and (masks[1500:] & 2).all()
    others = known.masks(rng.integers(0, 1 << 62, 200_000).view(np.uint64))
    for bit in range(2):
        assert np.mean(others >> bit & 1) == pytest.approx(known.false[bit], rel=0.2)


@pytest.mark.parametrize("languages", [1, 64, 65, 130])
def test_any_number_of_languages(languages):
    import pyarrow as pa

    texts = [" ".join(chr(0x4E00 + 7 * n + i) * 2 for i in range(7)) for n in range(languages)]
    names = [f"l{n:03}" for n in range(languages)]
    rows = [(name, int(g)) for name, t in zip(names, texts) for g in langid.trigrams([t])[0]]
    langs, grams = zip(*reversed(rows))
    table = pa.table({"lang": langs, "gram": pa.array(np.array(grams, np.uint64).view(np.int64))})
    known = langid._filter(table, langid.Learning())
    assert known.languages == tuple(names)
    assert langid.predict_texts(texts, known)[0] == names


def test_correction_removes_what_chance_explains():
    counts = langid.corrected(np.array([[60.0, 10.0]]), np.array([100.0]), np.array([0.0, 0.1]))
    assert counts.tolist() == [[60.0, 0.0]]


def test_trigrams_match_a_plain_count():
    texts = ["Ab c", "", "é1x", "  ", "x"]
    grams, (first, last), letters = langid.trigrams(texts)

    def plain(text):
        out = []
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            marked = f"\0{word}\0"
            out += [marked[i : i + 3] for i in range(len(marked) - 2)]
        return out

    unpacked = ["".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in grams]
    assert [unpacked[a:b] for a, b in zip(first, last)] == [plain(t) for t in texts]
    assert letters.tolist() == [3, 0, 2, 0, 1]


def test_odd_texts(make_docs, known):
    long = "the thing and " * 150_000
    rows = [(1, None), (2, ""), (3, "12 !"), (4, long), (4, long), (None, "the and the")]
    found = langid.predict(make_docs(rows), known).collect()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == ("und", 0.0)
    assert by_id[4][0] == by_id[None][0] == "en"
    assert len(found) == 6


def test_a_long_text_counts_like_its_parts(known):
    text = "and then he was ing the other " * 60_000
    whole = langid.predict_texts([text], known)[1][0]
    part = langid.predict_texts([text[: len(text) // 60_000 * 300]], known)[1][0]
    assert whole == pytest.approx(part, abs=0.01)


def test_empty_tables_and_nothing_learnt(make_docs, known):
    none = make_docs([])
    assert langid.predict(none, known).collect() == []
    untaught = langid.learn(make_docs([(1, "some text", None), (2, None, "en"), (None, "a", "en")]))
    assert langid.predict_texts(["some text"], untaught)[0] == ["und"]


@pytest.mark.parametrize("piece", [4, 5, 9, 16])
def test_pieces_have_the_trigrams_of_the_whole(monkeypatch, piece):
    rng = np.random.default_rng(piece)
    texts = ["".join(rng.choice(list("abÉ漢字ΣİA .,1"), size=n)) for n in (0, 1, 3, 17, 60, 200)]
    texts += ["漢字仮名" * 40, "." * 90, "a" * 50 + "." + "b" * 50, None]
    monkeypatch.setattr(langid, "PIECE", piece)
    found = [[] for _ in texts]
    letters = np.zeros(len(texts), int)
    for grams, (first, last), here, row in langid._pieces(texts):
        for a, b, n, r in zip(first, last, here, row, strict=True):
            found[r] += grams[a:b].tolist()
            letters[r] += n
    for text, mine, n in zip(texts, found, letters, strict=True):
        whole, (first, last), here = langid.trigrams([text or ""])
        assert mine == whole[first[0] : last[0]].tolist()
        assert n == here[0]


def test_learning_counts_the_trigrams_of_the_whole(monkeypatch):
    import pyarrow as pa

    text = "漢字仮名交じり文" * 9 + " ab" * 9
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x"]), pa.array([text, "zz", text])], ["lang", "text"])

    def counted():
        out = {}
        for part in langid._counted(iter([batch])):
            for lang, gram, times in zip(*[c.to_pylist() for c in part.columns], strict=True):
                out[lang, gram] = out.get((lang, gram), 0) + times
        return out

    whole = counted()
    monkeypatch.setattr(langid, "PIECE", 6)
    assert counted() == whole


def test_languages_with_the_most_rows_are_learnt(make_docs):
    rows = [(i, "the thing and the other thing " * 3, "en" if i < 6 else f"x{i:02}") for i in range(12)]
    known = langid.learn(make_docs(rows), how=langid.Learning(languages=2))
    assert known.languages == ("en", "x06")
