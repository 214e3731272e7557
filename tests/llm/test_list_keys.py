"""The case of list keys."""

from loam.llm.url_filter import url_filter


def test_list_keys_keep_the_case_of_paths(spark):
    caps = spark.createDataFrame([("http://B.com/Spam/x", 5), ("http://b.com/spam/x", 5), ("http://c.org/", 5)], "url string, fetched int")
    lists = spark.createDataFrame([("B.com/Spam", "add", 1), ("C.org", "add", 1), ("c.org", "remove", 3)], "key string, action string, since int")
    got = {(r["url"], r["url_filter"]["blocked"], r["url_filter"]["first_key"]) for r in url_filter(caps, lists).collect()}
    assert got == {("http://B.com/Spam/x", True, "b.com/Spam"), ("http://b.com/spam/x", False, None), ("http://c.org/", False, None)}
