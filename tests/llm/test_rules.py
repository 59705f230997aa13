import re

import pytest

from ledgerlake.llm import common, quality_rules, queries, url_filter


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def check(df):
    found = quality_rules.quality_rules(df)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = []
    for r in df.select("doc_id", "text").collect():
        c = brute_counts(r.text)
        want.append((r.doc_id, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(want, key=str)
    return found


def test_base_counts(documents, odd_documents, no_documents):
    check(documents)
    found = check(odd_documents)
    assert found.where("kept is null").count() == 0 and found.where("base_failed and kept").count() == 0
    check(no_documents)


def test_repeats_overlap_and_touch(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a a a a a", "x y z a b c d e q a b c d e r", "a b c d e f a b c d e f g", "1 2 3 4", "1 2 3 4 5", "# # # # # #", "a\nb\na\n\n \n \n"]
    check(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))


def test_clean_documents_stay_and_shouting_goes(documents, labels):
    found = quality_rules.quality_rules(documents).join(labels, "doc_id").where("not base_failed")
    good = found.where("quality = 1")
    assert good.where("kept").count() == good.count()
    assert found.where("quality = 0 and not kept").count() > 0


def test_python_never_runs(documents):
    plan = quality_rules.quality_rules(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


URLS = [
    (1, "http://a.example.com/en/7x?q"), (2, "https://EXAMPLE.com/en/8"), (3, "x://net/de/1"), (4, "http://sub.example.net/de/8"), (5, "http://example.net/de/8#f"),
    (6, "http://org/es/"), (7, "http://notnet/de/"), (8, None), (9, "no scheme"), (10, "http://h.example.com"), (11, "a://b://c/d"), (12, "http://h?x/en/"), (13, ""),
    (14, "http://m.spam-farm.example.org/x"), (15, "http://myspam-farm.example.org/x"), (None, "http://spam-farm.example.org/es/1"), (16, "http://É.COM/En/"), (16, "http://É.COM/En/"), (17, "http://" + "a." * 300 + "spam-farm.example.net/" + "p" * 100_000),
]


def brute_url(url, rules, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len, default=None)
    parents = {".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)}
    return host, path, rule, rules[rule] if rule else "block" if parents & set(listed) else "allow"


def test_urls(spark, pages):
    odd = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as path", "1 as key", "'z' as verdict", "2 as _listed")
    for df in (odd, pages.select("page_id", "url"), odd.where("false")):
        found = url_filter.judge_urls(df, queries.RULES, queries.BLOCKED_DOMAINS)
        want = [(r.page_id, *brute_url(r.url, queries.RULES, queries.BLOCKED_DOMAINS)) for r in df.select("page_id", "url").collect()]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_the_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('h', id, '.example') as key")
    listed = universe.where("crc32(key) % 40 = 0").union(spark.createDataFrame([("outside.example",), (None,)], "key string"))
    cascade = url_filter.Cascade.build(listed, universe)
    assert len(cascade.levels) > 2
    judged = universe.select("key", cascade.has(url_filter.F.col("key")).alias("in"))
    assert {r.key for r in judged.where("in").collect()} == {r.key for r in listed.intersect(universe).collect()}


def test_a_list_of_many_hosts_needs_many_levels(spark):
    """A third of 30,000 hosts, some by their parent domain: the verdicts are those of plain membership."""
    urls = spark.range(30_000).selectExpr("id as page_id", "concat('http://h', id, '.d', id % 5000, '.example/') as url")
    listed = [f"h{i}.d{i % 5000}.example" for i in range(0, 30_000, 4)] + [f"d{i}.example" for i in range(0, 5000, 11)] + ["elsewhere.example"]
    found = {r.page_id: r.verdict for r in url_filter.judge_urls(urls, {}, listed).collect()}
    assert found == {i: "block" if i % 4 == 0 or i % 5000 % 11 == 0 else "allow" for i in range(30_000)}


def brute_kept(rows):
    """The verdict on each (lang, text) by plain counting of characters and words."""
    import unicodedata
    from collections import Counter
    from math import log2, sqrt

    def classes(text):
        out = [0] * 6
        for c in text:
            k = unicodedata.category(c)
            i = 0 if k == "Ll" else 1 if k == "Lu" else 2 if k in ("Lt", "Lm", "Lo", "Mn", "Mc", "Me") else 3 if k[0] == "N" else 5 if k[0] == "S" or c in "#*%&" else 4 if k[0] == "P" else None
            if i is not None:
                out[i] += 1
        return out

    def common(text):
        w = Counter(x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text))
        out = [w[x] for x in quality_rules.COMMON_WORDS]
        return [*out, sum(w.values()) - sum(out)]

    def distance(a, b):
        if not sum(a) or not sum(b):
            return 0
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        return sqrt(max(0, sum((x * log2(2 * x / (x + y)) if x else 0) + (y * log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2))

    bad = [(c := brute_counts(t))[0] < 10 or 100 * c[4] > 20 * c[0] for _, t in rows]
    made, refs = [(classes(t or ""), common(t or "")) for _, t in rows], {}
    for (lang, _), b, (x, y) in zip(rows, bad, made):
        if not b:
            r = refs.setdefault(lang or "", ([0] * 6, [0] * 41))
            r[0][:], r[1][:] = [a + c for a, c in zip(r[0], x)], [a + c for a, c in zip(r[1], y)]
    out = []
    for (lang, _), b, (x, y) in zip(rows, bad, made):
        r = refs.get(lang or "", ([0], [0]))
        far = (sum(x) >= quality_rules.MIN_CHARS and distance(x, r[0]) > quality_rules.MAX_CLASS_DISTANCE) or (sum(y) >= quality_rules.MIN_WORDS and distance(y, r[1]) > quality_rules.MAX_WORD_DISTANCE)
        out.append(not b and not far)
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_verdicts_match_plain_counting_with_any_number_of_languages(spark, documents, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    many = spark.range(90).selectExpr("1000 + id as doc_id", "repeat(concat('word', id, ' of the '), 4 + int(id)) as text", "concat('lang', id) as lang")
    menus = spark.createDataFrame([(2000 + i, " | ".join(f"Item{(i * 37 + j) % 991}" for j in range(200)), "en") for i in range(3)] + [(3000, "plain words of the text " * 9, None), (3001, "ab " * 99, "")], "doc_id long, text string, lang string")
    df = documents.select("doc_id", "text", "lang").union(many).union(menus)
    rows = df.collect()
    want = dict(zip((r.doc_id for r in rows), brute_kept([(r.lang, r.text) for r in rows])))
    found = {r.doc_id: r.kept for r in quality_rules.quality_rules(df).collect()}
    assert found == want and not any(found[2000 + i] for i in range(3))


def test_an_empty_list_blocks_nothing(spark, pages):
    assert url_filter.judge_urls(pages, {}, spark.createDataFrame([], "key string")).where("verdict = 'block' or rule is not null").count() == 0
