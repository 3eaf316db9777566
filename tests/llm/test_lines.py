"""Recurring lines by host, held against a plain count over whole texts."""

import re
from collections import defaultdict

from heronwatch.llm import line_quality


def body(i, part=0):
    return " ".join(f"w{part}x{i}x{k}".translate({48 + d: 97 + d for d in range(10)}) for k in range(40))


def plain(rows, max_docs, max_share):
    """{doc_id: words of its lines above the limits}, line by line."""
    texts, has = defaultdict(set), defaultdict(set)
    normal = lambda line: " ".join(re.sub("[0-9]+", "0", line.lower()).split())
    for _, t, host in rows:
        texts[host].add(t)
        for line in t.split("\n"):
            if line.split():
                has[host, normal(line)].add(t)
    above = {k for k, v in has.items() if len(v) > max_docs and len(v) > max_share * len(texts[k[0]])}
    return {i: sum(len(x.split()) for x in t.split("\n") if x.split() and (host, normal(x)) in above) for i, t, host in rows}


def test_header_and_footer_of_one_host(spark):
    foot = "About us and contact\nAll rights reserved by nobody\nFollow the flock on paper"
    page = lambda i: f"Welcome to the heron post\n{body(i)}\n{body(i, 1)}\n{foot}"
    rows = [(i, page(i), "post") for i in range(60)] + [(100 + i, page(100 + i), "small") for i in range(20)]
    rows += [(200 + i, f"Welcome to the heron post\n{foot}\n{foot}\n{foot}\n{foot}\n{i % 30} birds\nand {body(0)[:250]}", "post") for i in range(40)]  # 40 rows, 30 texts
    rows += [(300 + i, f"{body(777)}\n{body(777, 1)}", "post") for i in range(50)]  # copies of one text
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_quality.query(docs).collect()}
    want = plain(rows, line_quality.MAX_DOCS, line_quality.MAX_SHARE)
    assert {i: r.n_line_words_removed for i, r in got.items()} == want
    assert all(want[i] == 19 and got[i].kept for i in range(60)) and all(want[i] == 0 for i in [*range(100, 120), *range(300, 350)])
    assert all(got[i].depleted and not got[i].kept for i in range(200, 240)) and all(got[i].kept for i in range(300, 350))
    kept = {r.doc_id: r.text for r in line_quality.keep(docs).collect()}
    assert kept[3] == f"{body(3)}\n{body(3, 1)}" and kept[103] == page(103) and kept[310] == rows[-1][1] and 200 not in kept


def test_share_of_the_host_is_a_limit(spark):
    rows = [(i, f"{'Mind the step' if i < 30 else 'Mind the gap'}\n{body(i)}\n{body(i, 1)}", "a") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_line_words_removed for r in line_quality.judge(docs, max_docs=20, max_share=0.4).collect()}
    assert got == plain(rows, 20, 0.4) and got[5] == 0 and got[50] == 3
