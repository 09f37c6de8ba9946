"""Abstracts by their headings, against a plain reading of the rules: head first, then the whole text."""

import random
import re

import pytest

from stacklore.operators import abstracts

PAGES = "doc_id long, page int, text string"
LONG = "Owls hunt at night and sleep by day in hollow trees, which few other birds of this size would do here."


def got(spark, *documents):
    rows = [(i, n, text) for i, pages in enumerate(documents) for n, text in enumerate(pages)]
    random.Random(1).shuffle(rows)
    out = abstracts.paper_abstracts(spark.createDataFrame(rows, PAGES)).collect()
    return [(r.abstract, r.reason) for r in sorted(out)]


def test_where_abstracts_begin_and_end(spark):
    assert got(
        spark,
        [f"On owls\n  Abstract: {LONG}\nKeywords: owls"],
        [f"On owls\nABSTRACT\n{LONG} Keywords owls"],
        [f"x\n摘 要：{LONG}\n关键词 猫头鹰"],
        ["cover page", f"more\n\n\nSummary.\n{LONG}\n\n1. Introduction\nIt is"],
        [f"Abstract {LONG}", f"{LONG}\nII method\nI introduction the"],
        [f"The Abstract {LONG}"],
    ) == [
        (LONG, "heading-en"),
        (LONG, "heading-en"),
        (LONG, "heading-cn"),
        (LONG, "heading-en"),
        (f"{LONG} {LONG} II method", "heading-en"),
        (f"The Abstract {LONG}", "fallback-first-pages"),
    ]


def test_short_missing_and_empty(spark):
    assert got(spark, ["Abstract: brief\nKeywords"], [None, "b", "c"], [None, "  \n"], [""]) == [
        ("Abstract: brief Keywords", "fallback-first-pages"), ("b", "fallback-first-pages"), (None, None), (None, None),
    ]
    assert got(spark, ["Abstract\n" + "w " * 4000], ["v " * 4000]) == [(("w " * 1500).strip(), "heading-en"), (("v " * 1000).strip(), "fallback-first-pages")]
    assert abstracts.paper_abstracts(spark.createDataFrame([], PAGES)).count() == 0


def test_many_empty_lines_take_no_square_time(spark):
    assert got(spark, ["\n" * 400_000 + f"Abstract {LONG}"]) == [(LONG, "heading-en")]


def plain(pages):
    full = "".join(("\n" if i else "") + p + "\n" for i, p in enumerate(pages))
    front = "".join(("\n" if i else "") + p + "\n" for i, p in enumerate(pages[:2]))
    start = re.compile(r"(?m)^\s*(?:(?P<cn>摘\s*要)|Abstract|ABSTRACT|Summary|SUMMARY)\s*[：:.]?\s*")
    m = start.search(full.encode()[:5000].decode(errors="ignore")) or start.search(full)
    if m:
        body = re.sub(rf"([。.])\s+({abstracts.NEXT})", r"\1\n\2", full[m.end() :])
        stop = re.search(rf"(?im)^\s*{abstracts.NEXT}", body)
        text = " ".join(body[: stop.start() if stop else None][:3000].split())
        if len(text) >= 80:
            return text, "heading-cn" if m["cn"] else "heading-en"
    text = " ".join(front[:2000].split())
    return (text, "fallback-first-pages") if text else (None, None)


@pytest.mark.parametrize("seed", range(3))
def test_random_papers(spark, seed):
    r = random.Random(seed)
    parts = [LONG, "\n", "\n\n", " ", "Abstract", "\nAbstract: ", "\n 摘　要", "Summary ", "\nKEY WORDS", ". Introduction", "。 引 言", "\n1 introduction", "\nabstract", "tiny", "\nIndex terms", "𝛼 ", "é"]
    documents = [["".join(r.choices(parts, k=r.randrange(0, 30))) + LONG * r.choice([0, 0, 60]) for _ in range(r.randrange(1, 5))] for _ in range(60)]
    assert got(spark, *documents) == [plain(d) for d in documents]
