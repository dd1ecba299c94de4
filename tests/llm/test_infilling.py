"""Fill-in-the-middle examples against a plain cut of every text."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from corpus import documents, edge_texts, texts

from auditlake.llm import infilling

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text, shares=(50, 80)):
    text = text or ""
    units = UNIT.findall(text)
    drawn = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= shares[0]:
        return doc_id, len(units), "plain", None, None, text, text
    form = "spm" if h[3] % 100 < shares[1] else "psm"
    made = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), made, text


def rows_of(df):
    return sorted((tuple(r) for r in infilling.restore(df).collect()), key=str)


def test_examples_are_those_of_a_plain_cut(spark):
    rng = random.Random(3)
    parts = [" ", "\t", "\n", "\x0b", "\r", "a", "bé", "漢", "<P>", "<", "P>", "<S", "<M", ">", "\x85", "\xa0", "\x1f", "\x00", "😀"]
    given = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + texts() + edge_texts()
    ids = [rng.choice([None, -i, i, i, i]) for i in range(len(given))]
    given += given[-2:]
    ids += ids[-2:]
    made = rows_of(infilling.fill_in_middle(documents(spark, given, ids).repartition(3)))
    assert made == sorted((plain(i, t) for i, t in zip(ids, given)), key=str)
    assert {r[2] for r in made} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("shares", [(0, 80), (100, 0), (100, 100)])
def test_shares_of_forms(spark, shares):
    given = ["one two three", "", None, " x", "y "]
    made = rows_of(infilling.fill_in_middle(documents(spark, given), shares=shares))
    assert made == sorted((plain(i, t, shares) for i, t in enumerate(given)), key=str)


def test_very_long_text_and_empty_table(spark):
    given = ["word " * 2_000_000, "x" * 9_000_000, "short one"]
    made = rows_of(infilling.fill_in_middle(documents(spark, given), shares=(100, 80)))
    assert made == sorted((plain(i, t, (100, 80)) for i, t in enumerate(given)), key=str)
    assert rows_of(infilling.fill_in_middle(documents(spark, []))) == []


def test_units_are_those_of_the_pattern():
    given = ["", " ", "a", " a", "a ", "a  b\n", "\xa0 \x85", "é\té"]
    units = infilling.units_of(pa.array([t.encode() for t in given], pa.large_binary())).to_pylist()
    assert [[u.decode() for u in own] for own in units] == [UNIT.findall(t) or [""] for t in given]
