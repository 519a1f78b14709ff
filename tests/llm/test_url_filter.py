from codeloom.llm.queries import URL_RULES
from codeloom.llm.url_filter import DigestArray, match_rules, pack

URLS = ["http://www.Example.com/en/1?x=/fr/", "https://m.example.com/en/", "http://example.com/de/", "http://a.net/es/x", "http://net/fr/", "http://a.net/fr", "ftp://com", "http://com/", "no scheme", "", None, "http://badexample.com/en/1", "http://a.org/x", "x://y://z.net/es/#q", "http://é.net/es/ü"]


def slow(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*URL_RULES, (None, "org", "/")], "verdict string, host string, path string")
    for most in (64 << 20, 120):  # one array, and several
        got = {r["page_id"]: tuple(r)[1:] for r in match_rules(pages, rules, max_bytes=most).collect()}
        assert got == {i: slow(u) for i, u in enumerate(URLS + URLS)}


def test_collisions_are_confirmed_by_the_string(spark):
    import pandas as pd
    import xxhash

    key = xxhash.xxh64_intdigest(b"a.com/", 42)
    signed = key - (1 << 64) if key >= 1 << 63 else key
    blob, _ = pack(pd.DataFrame({"key": [signed, signed], "text": ["other.com\x00/", "a.com\x00/"], "path_length": [1, 1], "block": [0, 1]}))
    array = DigestArray(blob)
    assert array.text(array.find([b"a.com\x00/"])[0]) == b"a.com\x00/"
    assert array.find([b"b.com\x00/"])[0] == -1


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert match_rules(pages, rules).first()["verdict"] == "allow"
    assert match_rules(pages.limit(0), rules).count() == 0


def test_very_long_hosts(spark):
    """A host of a million labels, and one of a million characters, cost what their few last labels do."""
    urls = [f"http://{'a.' * 1_000_000}example.com/en/x", f"http://{'b' * 1_000_000}/en/", f"http://{'.' * 1_000_000}net/fr/", "http://www..com/", "http://com./"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in match_rules(pages, rules).select("page_id", "rule", "verdict").collect()}
    assert got == {i: slow(u)[2:] for i, u in enumerate(urls)}
