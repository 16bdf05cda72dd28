import random

import numpy as np

from quillmesh.llm.truncation import TruncationModel, _cells, _codes, _symbols, _threshold, final_core, site_rates, truncated_articles

SCHEMA = "article_id string, domain string, language string, body string, key string"
PARTS = ["The plant in {} will audit {} tools before May.", "Shares of {} rose {} percent after a quiet week.", "{} said it would lease its line of {} chambers.", "Does the shift leave {} with {} orders?"]


def _body(pick):
    name = lambda: pick.choice("KLMNPRST") + "".join(pick.choice("aeiourln") for _ in range(6))
    lines = [" ".join(pick.choice(PARTS).format(name(), pick.randrange(900)) for _ in range(pick.randrange(2, 5))) for _ in range(pick.randrange(3, 6))]
    return "\n\n".join(lines + pick.sample(["© 2024 Site — all rights reserved", f"Share this story ({pick.randrange(900)})", f"{name()} / {name()}", "Advertisement"], 2))


def _rows(n=900):
    pick = random.Random(4)
    rows, cut = [], set()
    for i in range(n):
        body = _body(pick)
        if i % 6 == 0:
            at = pick.randrange(60, len(body) - 90)
            while body[at - 1] in ".?\n)" or body[at] == "\n" or body[at - 1].isspace():
                at -= 1
            body = body[:at] + pick.choice(["", "", " ", "...", " [...]", "…", "&nb", "<a href=", "�", " [+99 chars]"])
            cut.add(f"a{i}")
        rows.append((f"a{i}", "s.com", "en", body, "k"))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = _rows()
    rows += rows[:5] + [("n", "s.com", "en", None, None), ("b", "s.com", None, " \n ", None), (None, "s.com", "en", "x", None), ("d", None, None, "A whole text ends here.\n" * 400, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["article_id"] for r in truncated_articles(df).collect()}
    assert len(found & cut) / len(cut) > 0.93 and len(found - cut) <= 0.02 * len(rows)
    assert "n" not in found and "b" not in found and "d" not in found
    rate = {r["domain"]: r for r in site_rates(df).collect()}
    assert rate["s.com"]["articles"] == 900 and rate["s.com"]["truncated"] == len(found)


def test_long_text_counts_like_short_ones(spark):
    line = "Shares of Karula rose 5 percent after a quiet week.\n"
    long = [("l", "s", "en", line * 45000, None)]
    assert truncated_articles(spark.createDataFrame(long, SCHEMA)).count() == 0


def test_empty(spark):
    assert truncated_articles(spark.createDataFrame([], SCHEMA)).count() == 0
    assert TruncationModel(spark.createDataFrame([], SCHEMA)).judged().count() == 0


def test_symbols():
    text = lambda s: "".join(map(chr, _symbols(_codes(s))))
    assert text("\nThe Plant  of Kara-Mere, \r\n\n Vol 1,250.5 at £30 x-12") == "\nThe X  of X,\nVol 0 at £0 x-00"
    assert text("据Tylecore介绍") == "据X介绍" and text("") == ""
    assert np.array_equal(_symbols(_codes("ab")), _codes("ab"))


def test_marks():
    assert final_core("cut he [...]", True) == ("\ncut he", True) and final_core("wait…” ", False) == ("wait…”", False)
    assert final_core("R&D", False) == ("R&D", False) and final_core("x &amp", False) == ("x", True)


def test_threshold_moves_smoothly_to_its_own_language():
    """A small language follows all languages' gap, a large one its own; between them nothing switches."""
    gap = lambda at: _cells([(c / 8 - 6.0, 0 if abs(c / 8 - 6.0 - at) < 0.5 else 40) for c in range(34)])
    pooled, own = gap(-4.5), gap(-2.5)
    picked = [_threshold(own * size, pooled * 100) for size in (1e-6, 1e-3, 0.1, 1.0, 10.0, 1e4)]
    assert abs(picked[0] + 4.5) < 0.3 and abs(picked[-1] + 2.5) < 0.3 and picked == sorted(picked)
    assert _threshold(own * 0, pooled * 0) == min((-3.875, -3.625), key=lambda x: abs(x - _threshold(own * 0, pooled * 0)))


def test_bounded_state_loses_no_count(spark, monkeypatch):
    """Workers that pass on their counts early and bitmaps of many parts give the same log-odds."""
    df = spark.createDataFrame(_rows(120)[0], SCHEMA)
    odds = lambda: {(r["article_id"], round(r["log_odds"], 9)) for r in TruncationModel(df).judged().collect()}
    want = odds()
    monkeypatch.setattr("quillmesh.llm.truncation.PART_BITS", 6)
    monkeypatch.setattr("quillmesh.llm.truncation.MOST_BITS", 8)
    assert odds() == want
