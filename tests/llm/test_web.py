"""WARC archives and page texts."""

import random

import duckdb
import pytest

from querytide.llm import site_template, warc_salvage
from querytide.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"


def record(k, size=50):
    payload = (f"<p>page {k} WARC/1.1 \x1f\x8b\x08" + "x" * size).encode()
    return warc_salvage._record(f"urn:page:{k}", f"http://h/{k}", payload, warc_salvage.hashlib.sha1(payload).hexdigest(), None, "2000-01-01T00:00:00Z")


def names(content):
    found = list(warc_salvage.salvage(content))
    ends = [0]
    for start, size, _, _ in found:  # in order; records of one member share its place
        assert start >= ends[-1] or start + size == ends[-1]
        ends.append(start + size)
    assert ends[-1] <= len(content)
    return [r["record_id"] for _, _, gap, r in found if gap is None], [(s, n) for s, n, gap, _ in found if gap]


def members(n=6):
    return [warc_salvage._member(record(k)) for k in range(n)]


def test_sound_files():
    plain = b"".join(record(k) for k in range(4))
    assert names(plain) == ([f"urn:page:{k}" for k in range(4)], [])
    assert names(b"".join(members())) == ([f"urn:page:{k}" for k in range(6)], [])
    assert names(b"") == ([], [])
    assert names(plain + b"".join(members(2)))[1] == []
    large = warc_salvage._member(record(1, 17 << 20))
    assert large[-1] == 0 and names(large + members(1)[0]) == (["urn:page:1", "urn:page:0"], [])


def test_damaged_members_are_left_out_and_later_ones_found():
    parts = members()
    for broken in (parts[2][:-9], parts[2][:40] + b"\0\0\0" + parts[2][43:], b"noise" * 50, parts[2][:30]):
        content = b"".join([*parts[:2], broken, *parts[3:]])
        at = len(parts[0]) + len(parts[1])
        assert names(content) == ([f"urn:page:{k}" for k in (0, 1, 3, 4, 5)], [(at, len(broken))])
    cut = b"".join(parts)[:-20]
    assert names(cut) == ([f"urn:page:{k}" for k in range(5)], [(len(cut) - len(parts[5]) + 20, len(parts[5]) - 20)])


def test_damaged_plain_records():
    parts = [record(k) for k in range(4)]
    wrong = parts[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    for broken in (wrong, parts[1].replace(b"page 1", b"page 9"), parts[1][:60], parts[1][:-30]):
        content = b"".join([parts[0], broken, *parts[2:]])
        found, gaps = names(content)
        assert found == ["urn:page:0", "urn:page:2", "urn:page:3"]
        assert gaps == [(len(parts[0]), len(broken))]


def test_random_damage_never_loses_sound_records():
    choice = random.Random(9)
    parts = members(12)
    for _ in range(60):
        hit = choice.randrange(12)
        part = bytearray(parts[hit])
        at = choice.randrange(20, len(part) - 1)
        part[at] ^= 1 << choice.randrange(8)
        found, _ = names(b"".join([*parts[:hit], bytes(part), *parts[hit + 1 :]]))
        assert [f"urn:page:{k}" for k in range(12) if k != hit] == [n for n in found if n != f"urn:page:{hit}"]


def test_sound_records_inside_damaged_members():
    parts = [record(k, 3000) for k in range(8)]
    wrong = parts[3].replace(b"page 3", b"page 9")
    some = [f"urn:page:{k}" for k in (0, 1, 2, 4, 5, 6, 7)]
    member = warc_salvage._member(b"".join([*parts[:3], wrong, *parts[4:]]))  # one bad record in a sound member
    assert names(member + members(1)[0]) == ([*some, "urn:page:0"], [(0, len(member))])
    noise = random.Random(12).randbytes
    whole = [record(k) + noise(20) + record(k + 10).replace(b"<p>page", noise(7)) for k in range(0, 8, 2)]
    cut = warc_salvage._member(b"".join(whole))[:-300]  # damage inside and the end cut off
    found, gaps = names(cut + members(1)[0])
    assert found[:2] == ["urn:page:0", "urn:page:2"] and found[-1] == "urn:page:0" and gaps == [(0, len(cut))]
    pack = warc_salvage.zlib.compressobj(0, warc_salvage.zlib.DEFLATED, 31)  # stored bytes with a wrong checksum
    plain = bytearray(pack.compress(b"".join(parts)) + pack.flush())
    plain[plain.index(b"page 5")] ^= 1
    assert names(bytes(plain))[0] == [f"urn:page:{k}" for k in (0, 1, 2, 3, 4, 6, 7)]
    two = warc_salvage._member(b"".join(parts))[:-40]  # both of two neighbouring members are damaged
    found, gaps = names(two + two)
    assert len(gaps) == 2 and found[:7] == [f"urn:page:{k}" for k in range(7)] and found.count("urn:page:6") == 2


def test_long_headers():
    long = record(1).replace(b"http://h/1", b"http://h/" + b"%20" * 50_000)
    assert names(long + record(2)) == (["urn:page:1", "urn:page:2"], [])
    assert names(warc_salvage._member(long) + members(1)[0]) == (["urn:page:1", "urn:page:0"], [])


def test_write_and_read(spark, folder):
    body = "é" * 600
    rows = [(1, "http://a/ \n", body), (2, None, body), (2, "u", body), (None, "n", body), (3, "s", "short"), (4, "s", "short"), (5, "e", None), (6, "e", ""), (7, "x", "y" * 400_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    warc_salvage.write_archives(warc_salvage.with_revisits(pages, "page_id", "url", "html"), f"{folder}/w")
    got = warc_salvage.read_archives(spark, f"{folder}/w").collect()
    assert all(r["gap"] is None for r in got) and len(got) == len(rows)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in got)
    assert kinds == sorted(
        [("urn:page:1", "revisit", "urn:page:2", 1200), ("urn:page:2", "response", "", 1200), ("urn:page:2", "response", "", 1200)]
        + [("urn:page:", "revisit", "urn:page:2", 1200), ("urn:page:3", "response", "", 5), ("urn:page:4", "response", "", 5)]
        + [("urn:page:5", "response", "", 0), ("urn:page:6", "response", "", 0), ("urn:page:7", "response", "", 400_000)]
    )
    assert {bytes(r["payload"]) for r in got if r["record_id"] == "urn:page:7"} == {b"y" * 400_000}
    warc_salvage.write_archives(warc_salvage.with_revisits(pages.limit(0), "page_id", "url", "html"), f"{folder}/e")
    assert warc_salvage.read_archives(spark, f"{folder}/e").count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    got = QUERIES[name](spark, TABLES)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_subtrees_of_few_pages_of_a_large_host_go(spark):
    def page(k):  # five adverts of a host of 100 pages, each on 20 of them at most, and a menu on six
        advert = f"<div>Buy {k % 7}</div>" if k % 7 < 5 else ""
        return f"<body>{advert}{'<div>Part A</div>' if k < 6 else ''}{'<div>Seen four times</div>' if k > 95 else ''}<p>text {k}</p></body>"

    pages = spark.createDataFrame([(k, "http://a.example/", page(k)) for k in range(100)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_template.extract(pages).collect()}
    assert got == {k: f"Seen four times\n\ntext {k}" if k > 95 else f"text {k}" for k in range(100)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div>
<main><article class="post"><header><h1>Head &amp; line</h1></header><p>One<br>two <b>th</b>ree&nbsp;x<p>Next
<div class="share">Share</div><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><form>f<input></form>
<aside>no</aside><section id="comments"><p>hi</p></section><!-- <p>gone</p> --></article></main><footer>f</footer>"""


def test_main_text():
    want = "Head & line\n\nOne two three x\n\nNext\n\na\n\nb\n\n1 2\n\n3"
    assert site_template.main_text(PAGE, set()) == want
    assert site_template.main_text('<div class="menu">x</div><p>a < b & c<p class=ad>q</p><h2>t', set()) == "a < b & c\n\nt"
    assert site_template.main_text("", set()) == "" and site_template.main_text('text <a href="', set()) == "text"
    assert site_template.main_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>y", set()) == "deep\n\ny"


def test_recurring_subtrees_go_and_recurring_prose_stays(spark):
    def page(k):
        return f"<body><div>Home {'x'} | About</div><p>text {k}</p><div><p>Some rights</p></div></body>"

    def article(k):
        return f"<article><div>Follow us</div><p>passage</p><p>own {k}</p></article>"

    rows = [(k, "http://a.example/x", page(k)) for k in range(9)] + [(50 + k, "https://B.example:80/", article(k)) for k in range(9)]
    rows += [(90, "http://c.example/", page(1)), (91, None, None), (92, "no host", "<p>x"), (90, "http://c.example/", page(1))]
    rows += [(200 + k, "http://d.example/", "<div>same page</div>") for k in range(9)]  # copies are one page
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in site_template.extract(pages).collect()}
    assert got[3]["text"] == "text 3" and got[53]["text"] == "passage\n\nown 3"
    assert got[90]["text"] == "Home x | About\n\ntext 1\n\nSome rights"
    assert got[91]["text"] == "" and got[91]["n_chars"] == 0 and got[92]["text"] == "x" and got[203]["text"] == "same page"
    assert site_template.extract(pages).count() == len(rows)
    assert site_template.extract(pages.limit(0)).count() == 0
