import time

import pytest
from pyspark.sql import functions as F

from docgauge.llm.page_shape_queries import SQL, p8_audit
from docgauge.llm.page_shapes import is_stuffed, page_shapes, stuffed_pages
from tests.oracle import assert_same, connect

PROSE = "Thank you for sending the revised permit, which reached me on Monday. The committee agreed to set aside a small sum for the new meter. "
CASES = [
    "lab scales, " * 40, "\n".join(["nicotine gum", "NICOTINE GUM", "nicotinegum"] * 15), "#pro #amber #samplekit #refill #dietpowder #blue " * 6,
    "\n".join(f"https://www.site{i}.example/page?id={i}" for i in range(20)), " | ".join(f"www.site{i}.test" for i in range(20)),
    " » ".join(f"site{i}[.]invalid" for i in range(20)), "\n".join(f'<a href="https://a{i}.example/x">moisture meter</a>' for i in range(15)),
    "\n".join(f"[label printer](http://a{i}.test/x)" for i in range(15)), "Tags: " + " | ".join(["blue", "refill", "leaf blend", "kliemka"] * 10),
    "Best lab scales for lab scales. Looking for lab scales? Our lab scales is the lab scales you need. The lab scales of all lab scales is lab scales. " * 4,
    "\n".join(f"Brand{'abcdefghij'[i % 10]} > carton sealer > white > 5kg" for i in range(14)), "\n".join(f"menthol pouch - Town{chr(97 + i)}" for i in range(20)),
    PROSE + "\n" + "buy vending machine online, cheap vending machine, vending machine sale, " * 20,
]
GENUINE = [
    None, "", " ", "- 29 -", "Holwair Foods Inc. / CONFIDENTIAL", PROSE, PROSE * 40, PROSE + "\nhttps://www.a.example/x\nhttps://www.b.example/y",
    "CONTENTS\n" + "\n".join(f"{i}. The unsigned map of the plant ........ {i * 7}" for i in range(1, 20)),
    "REFERENCES\n" + "\n".join(f"[{i}] T. Rieloandov, N. Crarbiendov: On the weekly container in Town. Annals of Studies 32, {i} (1957). https://www.a{i}.test/x" for i in range(1, 15)),
    "\n".join(f"R. Manvolert{chr(97 + i)}, Kushand & Sons, Paisgroxport" for i in range(20)), "\n".join(f"{i} x Hieckshaim diet powder, no. 75{i}, 12 kg @ 77.72 = $669.00" for i in range(20)),
    "Item  alpha  beta\n" + "\n".join(f"Touxhal C-{i}  82.30  44.77  n.d." for i in range(20)), "\n".join(f"boalttu, the damaged quota, {i}, {i + 40}" for i in range(20)),
    "\n".join(f"{i}. Is the early carton approved by the board?\n   [ ] Yes   [x] No   [ ] ?" for i in range(12)),
    "Name: L. Poandhuley\nDate: 13 June 1973\nDepartment: the damaged filter\nApproved by: C. Haix\nRemarks: ______",
    "As discussed, the lab scales file shows a small change in the weekly report of the plant. " * 12,
    "\n".join(f"The page on the weekly report describes how the plant was moved in spring and why the board agreed to it: https://a{i}.example/x" for i in range(8)),
]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_cases(text):
    assert is_stuffed(text)


@pytest.mark.parametrize("text", GENUINE, ids=range(len(GENUINE)))
def test_genuine_pages(text):
    assert not is_stuffed(text)


def test_short_page_of_stuffed_sentences():
    assert is_stuffed("Looking for lab scales? Our lab scales is the lab scales you need.\nGet lab scales in Tralfelham, lab scales in Nexthuville, lab scales!")
    firms = ["Biva Laboratories", "Flouxvund Foods Inc.", "Miler Leaf Corp.", "Puckbi Council"]
    assert not is_stuffed(" ".join(f"{firm} propose de fournir {81 + i} unités de grailtdream{i} aux mêmes conditions." for i, firm in enumerate(firms)))


def test_rotating_products():
    products = "moisture meter,label printer,lab scales,leaf blend,diet powder,paper sleeves,vending machine,carton sealer,smoke tester,menthol pouch,filter cartridge,nicotine gum".split(",")
    sentences = [f"Looking for {p}? Our {p} is the {p} you need." for p in products]
    assert is_stuffed("\n".join(sentences)) and is_stuffed(" ".join(sentences))
    assert is_stuffed("See the [note] first. " + " ".join(sentences[:1] * 6)) and is_stuffed("Ask A. B. Miller. " + " ".join(sentences[:1] * 6))
    people = "".join(f"{'BDFKLMPR'[i % 8]}. Vongorkert{chr(97 + i)}, Shearex {('Paper Mills', 'Leaf Corp.', 'Institute')[i % 3]}, Tainthirkham\n" for i in range(24))
    assert not is_stuffed("The meeting lasted until noon; two members left early.\n" + people)


def test_few_shapes_decide():
    """One pattern, or two, hold a page of spam; odd pieces of many shapes do not."""
    pieces = ["PRIVATE", "Blue copy", "third shelf left side", "Hall B | Row four", "Stoandgond Institute", "green folder > inner pocket > loose sheets", "old stock, new stock", "Kelwin; Tarbo; Musk", "to whom * from whom", "PAID IN FULL", "top drawer / desk eleven", "Do not bend"]
    assert is_stuffed("\n".join(pieces), few=1000) and not is_stuffed("\n".join(pieces))
    two = "\n".join(f"{a}\nhttps://www.{a}.example/x" for a in ("nicotine gum, lab scales", "leaf blend, nicotine gum", "lab scales, leaf blend") * 6)
    assert is_stuffed(two, few=2) and not is_stuffed(two, few=0)


def test_lines_fall_together_by_shape():
    shapes, lines = page_shapes("Lab scales - Town\nLeaf blend - Bay\nhttps://www.a.example/x\nhttps://b.example\nThe plant was moved in spring. The board agreed to it then.")
    assert sorted((s.kind() or "", len(s.lines)) for s in shapes.values()) == [("", 2), ("link", 2), ("list", 2)]
    assert len(lines) == 6 and sum(s.words for s in shapes.values()) == 3 + 3 + 1 + 1 + 6 + 6
    assert len(page_shapes("1. Is it? 2. Yes.")[1]) == 2 and len(page_shapes("Ask A. B. Miller. Then go.")[1]) == 2


@pytest.mark.parametrize("piece", ["www ", " ", "a.", "a-", "#a ", "1,", "x: ", "www a ", ".", "a. ", "<a", "buy lab scales ", "A. ", "[1] "])
def test_time_grows_in_proportion(piece):
    took = []
    for size in (60_000, 480_000):
        began = time.process_time()
        is_stuffed(piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)  # eight times the text; quadratic would be 64


def test_links_count_on_short_pages():
    assert is_stuffed("Dear M. Wixzoult,\n" + " » ".join(f"site{i}[.]example" for i in range(10))) and is_stuffed("\n".join(f"https://s{i}.test/a" for i in range(10)))
    assert not is_stuffed("https://s1.test/a") and not is_stuffed("See https://s1.test/a and https://s2.test/b for the minutes of the meeting.")


def test_one_phrase_over_and_over():
    assert is_stuffed("filter cartridges. FILTER CARTRIDGES. " * 12)
    assert not is_stuffed("\n".join(f"{i}. The board of the plant agreed that item {chr(97 + i)} should be moved to the next meeting.\nMotion carried." for i in range(12)))


def test_operator(spark):
    rows = [(i, t) for i, t in enumerate(CASES + GENUINE)] + [(None, CASES[0]), (0, CASES[0]), (999, "buy lab scales " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1))
    found = [r.doc_id for r in stuffed_pages(df.repartition(3), "doc_id", "text").collect()]
    assert sorted(found, key=str) == sorted([*range(len(CASES)), None, 0, 999], key=str)
    assert stuffed_pages(df.limit(0), "doc_id", "text").count() == 0


def test_audit_equals_sql(spark, data):
    assert_same(p8_audit(spark, data), connect(data), SQL["p8_audit"])
