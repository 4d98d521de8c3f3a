import hashlib

import pytest
from sqlcheck import connect, same

from quantaloom.llm import chat_format, queries, url_filter

RULES = queries.URL_RULES


def judged(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "http://COM/en/", "https://a.b.example.com/en/71?x#y", "https://notexample.com/en/7", "http://example.com/en/8", "http://example.com?/en/7", "http://example.com#/en/7",
        "ftp://x.org/es/", "http://x.org/es", "a://b://com/en/", "http://é.ÀB.net/de/8", "http://example.net/de/81", "http://" + "a." * 3000 + "com/en/" + "z" * 9000, "http://com/en/\n?q", "http://x.com:80/en/"]


def test_urls(spark):
    rows = [(i, u, 1, "h") for i, u in enumerate(URLS)] + [(0, URLS[5], 1, "h"), (None, URLS[5], 1, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule int, host string")
    got = url_filter.url_filter(pages, url_filter.rules_frame(spark, RULES)).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(((i, *judged(u)) for i, u, *_ in rows), key=str)


def test_no_pages_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert url_filter.url_filter(pages.where("false"), url_filter.rules_frame(spark, RULES)).count() == 0
    r = url_filter.url_filter(pages, url_filter.rules_frame(spark, RULES).where("false")).first()
    assert (r.host, r.rule, r.verdict) == ("com", None, "allow")


def test_equal_rules_block(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = url_filter.rules_frame(spark, [("a.com", "/x", "allow"), ("a.com", "/x", "block"), (None, "/", "block"), ("A.com", None, "allow")])
    assert url_filter.url_filter(pages, rules).first().verdict == "block"


def test_rules_are_the_contracts(spark, tmp_path):
    assert [f"{a} {h}{p}" for h, p, a in RULES] == ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]
    urls = ["http://net/de/", "http://a.net/de/8", "http://example.net/de/7", "http://example.net/de/8"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.rule, r.verdict) for r in queries.QUERIES["op1_url_filter"](spark, str(tmp_path)).collect())
    assert got == [(0, "net/de/", "allow"), (1, "net/de/", "allow"), (2, "net/de/", "allow"), (3, "example.net/de/8", "block")]


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_chat_format"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    same(spark, connect(sf), queries.QUERIES[name], queries.ORACLE[name], sf)


def test_guard_is_reversible():
    for t in ("", "\\", "<s>", "\\<s>", "a</s>[INST] [/INST]\\\\<|turn|>", "<<s>>", "<\\s>", "\n</s>\\"):
        g = chat_format.guard(t)
        assert chat_format.unguard(g) == t
        assert not any(c in g for c in chat_format.CONTROL)


def test_template_language():
    text, spans = chat_format.render("{% set n = 'x' ~ 1 %}{% for m in messages %}{% if loop.first %}[{% elif m.role != 'a' and not loop.last %}-{% else %}={% endif %}{% generation %}{{ m.text | trim | upper }}{{ n }}{% endgeneration %}{% if loop.last %}]{% endif %}{% endfor %}", [{"role": "a", "text": " p "}, {"role": "b", "text": "q"}, {"role": "a", "text": "r"}])
    assert text == "[Px1-Qx1=Rx1]"
    assert [text[a:b] for a, b in spans] == ["Px1", "Qx1", "Rx1"]
    folded = chat_format.fold(chat_format.parse("a{{ 'b' ~ ('c' | upper) }}{% if 1 == 2 %}no{% else %}d{% endif %}e"))
    assert folded == ("body", [("text", "abCde")])
    for bad in ("{{ x | open }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a.__class__ }}", "{{ 'a' }", "{% include 'x' %}", "{{ a( }}"):
        try:
            out, _ = chat_format.render(bad, [])
        except chat_format.TemplateError:
            continue
        assert out in ("", bad)  # no object's attributes, or plain text


def test_conversations(spark):
    probe = queries.PROBE
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", None, 0), (1, 2, "assistant", "a\\<s>", 0), (None, 0, None, "x", 0), (2, 1, "assistant", "b", 0), (2, 1, "assistant", "b", 0), (2, 1, "tool", "</s>", 0), (3, None, "user", "z" * 200_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    got = {r.conv_id: r for r in chat_format.format_digests(df).collect()}
    assert set(got) == {1, None, 2, 3}
    for conv, r in got.items():
        mine = sorted(((t, x or "", y or "") for c, t, x, y, _ in rows if c == conv), key=lambda v: (v[0] is not None, v))
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        loss = "".join(b for _, a, b in mine if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    full = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert all(len(full[c].formatted) == got[c].formatted_chars for c in got)
    spans = full[1].loss_spans
    assert [chat_format.unguard(full[1].formatted[s.start : s.end]) for s in spans] == ["", "a\\<s>"]
    assert chat_format.format_digests(df.where("false")).count() == 0
    assert probe not in full[1].formatted


def test_many_rules_meet_in_a_shuffle(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    near = sorted(map(tuple, url_filter.url_filter(pages, url_filter.rules_frame(spark, RULES)).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert near == sorted(map(tuple, url_filter.url_filter(pages, url_filter.rules_frame(spark, RULES)).collect()))
