import datetime
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from touchline.llm import urls

D = datetime.date
ENTRIES = [
    ("bad", "x.example.com", "add", D(2024, 1, 1)),
    ("bad", "x.example.com", "remove", D(2024, 3, 1)),
    ("bad", "example.com/a", "add", D(2024, 2, 1)),
    ("allow", "x.example.com/a/b", "add", D(2024, 2, 15)),
    ("ugly", "x.example.com", "add", D(2024, 1, 15)),
    (None, "example.com", "add", D(2024, 1, 1)),
    ("bad", None, "add", D(2024, 1, 1)),
    ("bad", "y.example.org", "add", D(2024, 1, 1)),
    ("bad", "y.example.org", "add", D(2024, 1, 1)),
]
URLS = ["http://X.example.com/", "https://x.example.com/a/b?q", "http://example.com/a", "http://example.com/ab", "http://zx.example.com/a//b/", "ftp://y.example.org:80/p", "nonsense", "", None]
DAYS = [D(2023, 12, 31), D(2024, 1, 1), D(2024, 2, 20), D(2024, 3, 1), None]


def expected(url, day):
    spans = []
    for name, pattern in {(e[0], e[1]) for e in ENTRIES if e[0] and e[1]}:
        own = sorted({(e[3], e[2]) for e in ENTRIES if e[:2] == (name, pattern)})
        for i, (start, action) in enumerate(own):
            end = own[i + 1][0] if i + 1 < len(own) else None
            if action == "add" and (end is None or end > start):
                spans.append((name, pattern, start, end))
    if not url or day is None or not urlsplit(url).hostname:
        return False, None, None, 0
    host, path = urlsplit(url).hostname, "/" + "/".join(s for s in urlsplit(url).path.lower().split("/") if s)
    met = []
    for name, pattern, start, end in spans:
        h, _, rest = pattern.partition("/")
        fits = (host == h or host.endswith("." + h)) and (not rest or path == "/" + rest or path.startswith(f"/{rest}/"))
        if fits and day >= start and (end is None or day < end):
            met.append((-len(pattern), name != "allow", name, pattern))
    if not met:
        return False, None, None, 0
    first = min(met)
    return first[1], first[2], first[3], len(met)


def test_matches_brute_force(spark):
    rows = [(u, d, "x", "y") for u in URLS for d in DAYS] * 2
    captures = spark.createDataFrame(rows, "url string, fetched_on date, pattern string, url_filter string")
    entries = spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, dated date")
    found = urls.filter_urls(captures, entries).collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r["url_filter"]) == expected(r["url"], r["fetched_on"]), r


def test_empty_tables(spark):
    entries = spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, dated date")
    captures = spark.createDataFrame([("http://x.example.com/", D(2024, 2, 1))], "url string, fetched_on date")
    assert urls.filter_urls(captures.limit(0), entries).count() == 0
    none = urls.filter_urls(captures, entries.limit(0)).select(F.col("url_filter.blocked")).collect()
    assert [r[0] for r in none] == [False]
