import base64
import hashlib

import duckdb
import pytest
import xxhash

from fringework.llm import urlfilter, warc


def test_address_parts():
    cases = {
        None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "http://A.Éx.com": ("a.Éx.com", ""), "https://h?x/y#z": ("h", ""), "x://Y.z/a/B?c": ("y.z", "/a/B"),
        "http://h#f/a": ("h", ""), "http:///p": ("", "/p"), "http://u@h:80/p#q?r": ("u@h:80", "/p"), "a://b://c/d": ("b:", "//c/d"),
    }
    for url, want in cases.items():
        assert urlfilter.parts(url) == want, url


@pytest.mark.parametrize(
    "host,path,want",
    [("x.com", "/en/1", ("block", "com/en/")), ("com", "/en/", ("block", "com/en/")), ("xcom", "/en/", None), ("www.example.com", "/en/78", ("allow", "example.com/en/7")), ("badexample.com", "/en/7", ("block", "com/en/")), ("a.example.net", "/de/81", ("block", "example.net/de/8")), ("a.net", "/de/8", ("allow", "net/de/")), ("x.org", "/fr/", None), ("", "", None)],
)
def test_rules(host, path, want):
    assert urlfilter.rule_for(host, path) == want


def test_held_out_addresses():
    """New addresses of words that the model knows, and of words that it was fitted without (those it hardly can know)."""
    w = urlfilter.fit(urlfilter.labelled())
    rows = [(y, urlfilter.score(w, *urlfilter.parts(u)) > 0) for y, u in urlfilter.labelled(5400)[1800:]]
    hits = sum(y and x for y, x in rows)
    assert hits >= 0.8 * sum(y for y, _ in rows) and hits >= 0.95 * sum(x for _, x in rows)
    recall, precision = urlfilter.held_out()
    assert recall >= 0.05 and precision >= 0.75


def test_labels_are_not_from_the_tables(spark):
    hosts = {urlfilter.parts(r.url)[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()}
    assert not hosts & {urlfilter.parts(u)[0] for _, u in urlfilter.labelled()} and ".example." not in str(urlfilter.labelled())
    assert not {w for h in hosts for name in h.split(".") for w in name.split("-")} & {*urlfilter.BLOCKED, *urlfilter.WANTED}


SQL = r"""
WITH a AS (SELECT page_id, url, strpos(url, '://') AS k FROM pages),
b AS (SELECT page_id, CASE WHEN coalesce(k, 0) = 0 THEN '' ELSE substr(url, k + 3) END AS rest FROM a),
c AS (SELECT page_id, rest, length(regexp_extract(rest, '^[^/?#]*')) AS n FROM b),
d AS (SELECT page_id, translate(substr(rest, 1, n), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, n + 1), '^[^?#]*') AS path FROM c),
r AS (SELECT * FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) t(verdict, rule))
SELECT d.page_id, d.host, d.path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
FROM d LEFT JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
GROUP BY ALL
"""


def slow_score(w, host, path):
    """The regression's sum by plain loops over the different hashed n-grams."""
    seen = set()
    for kind, text in (("h", host), ("p", path)):
        data = f"^{text}$".encode() if text else b""
        for n in (3, 4, 5):
            for i in range(len(data) - n + 1):
                seen.add(xxhash.xxh64_intdigest(kind.encode() + data[i : i + n]) % urlfilter.BUCKETS)
    return sum(w[k] for k in seen) / max(1, len(seen)) ** 0.5 + w[-1]


def test_whole_query_by_sql_and_brute_force(spark):
    """Host, path and rule by SQL, the other verdicts by plain loops, on every page."""
    from fringework.llm import queries

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    w = urlfilter.fit(urlfilter.labelled())
    want = [(p, h, a, r, v or ("block" if slow_score(w, h, a) > 0 else "allow")) for p, h, a, r, v in con.execute(SQL).fetchall()]
    got = queries.queries()["op5_urlfilter"](spark, d).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_judge(spark):
    rows = [(1, "http://x.com/en/1", "a"), (None, None, "b"), (3, "", "c"), (4, "https://www.pharmacy-pills.com/176/", "d"), (4, "https://gardenmuseum.org/fr/438", "e"), (5, "http://h/" + "x" * 50000, "f")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = urlfilter.judge(pages).collect()
    assert len(got) == 6 and [r.verdict for r in got][0] == "block" and [r.verdict for r in got][3:5] == ["block", "allow"]
    assert got[1].host == got[1].path == "" and got[1].rule is None and got[5].path == "/" + "x" * 50000
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_warc(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK", 3)
    html = ["<p>é</p>", "<p>é</p>", None, "", "x\r\n\r\ny", "z" * 100_000]
    rows = [(i, f"http://{'www.' * (i % 2)}h{i % 3}.example.com/p{i % 5}?q\n#f" if i % 7 else None, html[i % 6], "k") for i in range(40)] + [(None, "u", "<p>é</p>", "k"), (7, "u", "own", "k"), (7, "u", "own", "k")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    least = {}
    for i, _, h, _ in rows:
        least[h or ""] = min(least.get(h or "", 10**9), 10**9 if i is None else i)
    want, seen = [], set()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        response = i == least[h or ""] and (h or "") not in seen
        seen |= {h or ""} if response else set()
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else least[h or ""]))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(pages.where("page_id in (2, 3)"), least=1).collect()} == {"response"}

    folder = f"file://{tmp_path}/w"
    files = sorted(map(tuple, warc.index(warc.write(pages, folder), folder).collect()))
    for url in ("http://www.h1.example.com/p1?q\n", "u", "http://h9/", ""):
        found = [warc.parse(m)[0] for m in warc.lookup(folder, files, url)]
        assert len(found) == sum(warc.surt(u) == warc.surt(url) for _, u, _, _ in rows)


def test_surt():
    assert warc.surt("http://WWW.Example.com/A?b#c") == "com,example,www)/A?b" and warc.surt("https://h") == "h)/" and warc.surt(None) == ""
