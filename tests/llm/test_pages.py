import random
import tracemalloc

from ngramforge.llm import pages

SCHEMA = "page_id long, url string, html string"


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def follows(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        at = pages.shared(a, b)
        assert at == sorted(set(at)) and len(at) == longest(a, b) and follows([a[i] for i in at], b)
    a, b = ([rng.randrange(1500) for _ in range(1200)] for _ in range(2))
    assert len(pages.shared(a, b)) == longest(a, b)


def test_large_tables_are_halved(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(pages, "TABLE_BITS", 40)
    for _ in range(200):
        a, b = ([rng.randrange(7) for _ in range(rng.randrange(40))] for _ in range(2))
        at = pages.shared(a, b)
        assert at == sorted(set(at)) and len(at) == longest(a, b) and follows([a[i] for i in at], b)


def test_memory_of_long_differing_pages():
    a = list(range(16_000))
    b = list(a)
    random.Random(3).shuffle(b)
    tracemalloc.start()
    at = pages.shared(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert follows(at, b) and len(at) > 200 and most < 40_000_000


def test_partners_over_many_ranges(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h{rng.randrange(3)}.com/d{rng.randrange(2)}/{rng.randrange(40)}", f"<p>{i}</p>") for i in range(300)]
    rows += [(1000, "http://alone.com/x", "<p>z</p>")]
    want = {p: partner for p, (partner, _, _) in brute(rows).items() if partner is not None}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for ranges in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            assert {r.page_id: r.partner_id for r in pages.partners(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_lines():
    page = "<html><head><title>t</title></head><body><!-- no --><p>a <b>b</b>\n c</p><script>var x='<p>';</script><br>d &amp; e<li>f</li></body>"
    assert pages.lines(page) == ["a b", "c", "d & e", "f"]
    assert pages.lines("") == [] and pages.lines("<p>" * 5) == []
    assert pages.lines("<script>never closed") == [] and pages.lines("1 < 2") == ["1 < 2"]


def brute(rows):
    """partner and text by sorting each host's pages."""
    import re

    at = {}
    for page_id, url, _ in rows:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)", url or "")
        if page_id is not None and m and m[1]:
            at.setdefault(m[1].lower(), []).append((re.sub("[^/]*$", "", m[2]), m[2], page_id))
    partner = {}
    for own in at.values():
        own.sort()

        def same(a, b):
            n = 0
            for x, y in zip(own[a][1].split("/"), own[b][1].split("/")):
                if x != y:
                    break
                n += 1
            return n

        for i, (_, _, page_id) in enumerate(own):
            sides = [j for j in (i - 1, i + 1) if 0 <= j < len(own)]
            if sides:
                partner[page_id] = own[max(sides, key=lambda j: (same(i, j), -j))][2]
    lines = {p: pages.lines(h or "") for p, _, h in rows}
    out = {}
    for page_id, _, html in rows:
        own = lines[page_id]
        other = lines[partner[page_id]] if page_id in partner else []
        n = longest(own, other)
        out[page_id] = (partner.get(page_id), len(own), n if n < len(own) else 0)
    return out


def test_all_pages_as_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute(rows)
    got = pages.query(spark, sf_dir).collect()
    assert {r.page_id: (r.partner_id, r.n_lines, r.n_deleted) for r in got} == want
    whole = {p: pages.lines(h) for p, _, h in rows}
    assert all(follows(r.text.split("\n") if r.text else [], whole[r.page_id]) and (r.text.count("\n") + bool(r.text)) == r.n_lines - r.n_deleted for r in got)


def test_odd_pages(spark):
    menu = "<p>home</p><p>about</p>"
    rows = [
        (1, "http://a.com/x/1", f"{menu}<p>one</p>"),
        (2, "http://A.com/x/2?q", f"{menu}<p>two</p>"),
        (3, "http://a.com/x/2", None),
        (4, "http://b.com/", menu),
        (5, None, menu),
        (6, "no url", ""),
        (None, "http://a.com/x/1", menu),
        (7, "http://c.com/1", menu),
        (8, "http://c.com/2", menu),
        (9, "http://d.com/1", "<p>x</p>" * 30_000 + "<p>y</p>"),
        (10, "http://d.com/2", "<p>x</p>" * 30_000),
        (11, "http://e.com/1", "<p>q</p><p>r</p>"),
        (11, "http://e.com/1", "<p>q</p><p>r</p>"),
        (12, "http://e.com/1", "<p>q</p><p>s</p>"),
    ]
    frame = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", keys string")
    got = {}
    for r in pages.extract(frame).collect():
        got.setdefault(r.page_id, []).append((r.partner_id, r.n_lines, r.n_deleted, r.text))
    assert got[1] == [(2, 3, 2, "one")] and got[2][0][3] in ("two", "home\nabout\ntwo")
    assert got[3][0][1:] == (None, None, None)
    assert got[4] == [(None, 2, 0, "home\nabout")] == got[5] and got[6] == [(None, 0, 0, "")]
    assert got[None] == [(None, 2, 0, "home\nabout")]
    assert got[7] == [(8, 2, 0, "home\nabout")], "a copy keeps its lines"
    assert got[9] == [(10, 30_001, 30_000, "y")]
    assert got[11] == [(12, 2, 1, "r")] * 2 and got[12] == [(11, 2, 1, "s")]
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0
