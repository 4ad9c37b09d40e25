import numpy as np
import pytest
from grainmill.llm.urls import DigestArray, digest_array, filter_urls, split_url

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute(url):
    host, path = split_url(url)
    fits = []
    for rule, verdict in RULES.items():
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), rule, verdict))
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.NET/en/", "http://example.net/EN/", "http://xexample.net/en/",
    "http://example.net", "http://net/", "http://net", "https://b.example.com/de/x?y#z", "http://example.com/de",
    "ftp://x.org/fr/", "http://org/fr/a/b/c", "//example.net/en/", "no url", "", None, "http://?q=/en/", "http:///en/",
    "http://a.net?x://b.org/fr/", "http://example.net:80/en/", "http://é.net/ü", "http://a.b.c.d.e.net/" + "x/" * 5000,
    "http://..net/", "http://net./",
]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(URLS)], "page_id long, url string, html string, rule string")
    rows = filter_urls(pages.union(pages).repartition(3), RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]])
    assert filter_urls(pages.limit(0), RULES).count() == 0


def test_equal_digests_are_confirmed_on_the_text(tmp_path):
    path = tmp_path / "rules.bin"
    data = bytearray(digest_array({f"h{k}.net/": "block" for k in range(50)}))
    path.write_bytes(data)
    array = DigestArray(str(path))
    assert (np.diff(array.keys.astype(float)) >= 0).all()
    assert array.probe(["h7.net/", "other/"]) == {0: "block"}
    # All digests alike: every text has to be compared.
    keys = np.frombuffer(bytes(data[16 : 16 + 400]), "<u8")
    data[16 : 16 + 400] = np.full(50, keys[0], "<u8").tobytes()
    path.write_bytes(data)
    same = DigestArray(str(path))
    first = next(f"h{k}.net/" for k in range(50) if array.probe([f"h{k}.net/"]) and same.probe([f"h{k}.net/"]))
    assert same.probe([first]) == {0: "block"}


def test_only_rules_that_end_with_a_slash():
    with pytest.raises(ValueError):
        digest_array({"example.net/en": "block"})
    assert DigestArray  # an empty list of rules is a valid file
    assert len(digest_array({})) == 16
