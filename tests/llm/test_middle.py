"""Fill-in-middle against plain slicing."""

import hashlib
import random

import pytest
from llm import middle

WORDS = ["größe", "plain", "漢字", "a", "😀x", "é"]


def some_texts():
    rng = random.Random(3)
    out = ["", "x", "  ", "\n\n", "漢", " lead", "tail \n"]
    for n in (2, 63, 64, 65, 700, 5000):
        out.append("".join(rng.choice(WORDS) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n)))
    return out


def plain_units(text, unit):
    """The units of a text, one by one."""
    if unit == "code_points":
        return list(text)
    blank = " \t\n\v\f\r"
    out = []
    for i, c in enumerate(text):
        new = (c not in blank and text[i - 1] in blank) if unit == "words" else text[i - 1] == "\n"
        if i == 0 or new:
            out.append("")
        out[-1] += c
    return out


@pytest.mark.parametrize("unit", middle.UNITS)
@pytest.mark.parametrize("gap, chunk", [(2, 7), (5, 64), (64, 1 << 20)])
def test_every_rank_is_found(unit, gap, chunk):
    for text in some_texts():
        units = plain_units(text, unit)
        index = middle.SkipList(text.encode(), unit, gap, chunk)
        assert (index.units, index.points) == (len(units), len(text))
        ranks = range(len(units) + 1) if len(units) < 300 else [*range(0, len(units), 97), len(units) - 1, len(units)]
        for rank in ranks:
            before = "".join(units[:rank])
            assert index.find(rank) == (len(before), len(before.encode()))
        for rank in (-1, len(units) + 1):
            with pytest.raises(IndexError):
                index.find(rank)


def test_lanes_grow_with_the_logarithm_of_the_units():
    index = middle.SkipList(b"ab " * 100_000, gap=8)
    assert 4 <= len(index.lanes) <= 8 and all(int(lane[:, 0].sum()) == 300_000 for lane in index.lanes)


def brute(doc, text):
    """The contract, by slices of the string."""
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return doc, n, "spm", a, b - a, sha(f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"), sha(text)
    return doc, n, "psm", a, b - a, sha(f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), sha(text)


def test_edges_and_documents(spark, edge, sample, nothing):
    marked = spark.createDataFrame([(i, t) for i, t in enumerate(["has <P> in it", "<S>", "near < P>", "<<S", "<P", "ends <", "M>"] * 9)], "doc_id long, text string")
    for docs in (edge, sample, marked):
        want = [brute(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, middle.measured(docs).collect()), key=str) == sorted(want, key=str)
    assert middle.measured(nothing).count() == 0
    assert {f for _, _, f, *_ in map(tuple, middle.measured(sample).collect())} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", middle.UNITS)
def test_outputs_give_the_text_back(spark, sample, unit):
    clashing = sample.withColumn("FIM_output", sample.lang).withColumn("fim_units", sample.n_chars)
    got = middle.transform(clashing, unit=unit)
    assert got.columns[: len(clashing.columns)] == clashing.columns and len(got.columns) == len(clashing.columns) + 6
    for row in got.collect():
        output, form = row["fim_output_"] or "", row["fim_form"]
        assert middle.restored(output.encode(), form).decode() == (row["text"] or "")
        if form != "plain":
            prefix = output.split("<P>")[1].split("<S>" if form == "psm" else "<M>")[0]
            assert len(prefix) == row["fim_prefix_chars"] and "".join(plain_units(row["text"], unit)[: len(plain_units(prefix, unit))]) == prefix


def test_other_units_and_forms_are_refused():
    with pytest.raises(ValueError):
        middle.SkipList(b"text", "pages")
    with pytest.raises(ValueError):
        middle.restored(b"no marker", "psm")
