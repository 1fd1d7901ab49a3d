from __future__ import annotations

import re
from collections import Counter

from termlens.llm import lines as L

PAGES = "page_id bigint, url string, html string, host string, text string"


def _lines(html):
    bare = re.sub(L.SILENT, "\n", html or "")
    bare = re.sub(L.TAG, "", re.sub(L.BREAKS, "\n", bare))
    return [x for x in (x.strip(" \t") for x in re.split("[\r\n]", bare)) if x]


def _brute(rows, ratio, least):
    sites = [(re.match(L.HOST, u or "") or ["", ""])[1].lower() for _, u, _ in rows]
    pages, on = Counter(sites), Counter((s, x) for s, (_, _, h) in zip(sites, rows) for x in set(_lines(h)))
    out = []
    for site, (page, _, html) in zip(sites, rows):
        held = _lines(html)
        left = [x for x in held if not (on[site, x] >= least and on[site, x] > ratio * pages[site])]
        out.append((page, site, len(held), len(held) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    menu = "<nav><ul><li>Home</li><li>About <b>us</b></li></ul></nav>"
    rows = [
        (i, f"https://User@Site{i % 2}.example.org:80/p/{i}", f"<title>t{i}</title>{menu if i % 3 else ''}<p>Text {i}<br>tail {i % 7}<script>x</p></script></p>")
        for i in range(40)
    ]
    rows += [
        (100, None, "<p>lone"), (101, "nothing", ""), (102, "mailto:a@b", None), (None, "http://site0.example.org", "Home\r\n\t Home \nnew"),
        (103, "http://small.example.org", menu), (104, "http://site1.example.org", "<p>" + "long " * 30_000 + "</p>" + menu),
        (105, "http://site1.example.org", menu), (105, "http://site1.example.org", menu), (106, "", "<<a>> b < c"),
    ]
    frame = spark.createDataFrame([(*r, "h", "t") for r in rows], PAGES).repartition(5)
    for ratio, least in ((0.1, 5), (0.5, 2)):
        got = sorted(map(tuple, L.dedup_page_lines(frame, ratio, least).collect()), key=str)
        assert got == _brute(rows, ratio, least)
    assert any(r[3] for r in got)
    assert L.dedup_page_lines(frame.limit(0)).count() == 0
