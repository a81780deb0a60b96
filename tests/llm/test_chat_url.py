import hashlib
import random

import numpy as np
import pytest

from orthoframe.llm import chat, url_filter

SF = "/root/testdata/sf0.01"


def test_parts_become_placeholders():
    f = chat.Formatter()
    f.message("user", [chat.Text("see <|image:0|> & "), chat.Image("s3://a", 28, 15), chat.Audio("b", 1.5), chat.Text("x")])
    f.message("assistant", [chat.Text("ok <|end|>"), chat.Document("c", 3), chat.Text(" done")])
    text, loss, files = f.result()
    assert [(a["kind"], a["ref"], a["tokens"], a["turn"]) for a in files] == [("image", "s3://a", 4, 0), ("audio", "b", 38, 0), ("document", "c", 768, 1)]
    assert all(text[a["position"] :].startswith(f"<|{a['kind']}:{k}|>") for k, a in enumerate(files))
    assert [chat.unescape(text[a:b]) for a, b in loss] == ["ok <|end|>", " done"]
    assert [r for r, _ in chat.parse(text)] == ["user", "assistant"]


def test_escaping_is_reversible():
    dice = random.Random(1)
    for _ in range(500):
        text = "".join(dice.choice("&<>|aelb/[]\n") for _ in range(dice.randrange(30)))
        assert chat.unescape(chat.escape(text)) == text and "<" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text
        f = chat.Formatter()
        f.message(text, [chat.Text(text)])
        f.message("assistant", [chat.Text(text)])
        assert chat.parse(f.result()[0]) == [(text, text), ("assistant", text)]
    with pytest.raises(ValueError):
        chat.parse("<|turn user|>a<|end|>b")


def test_odd_conversations(spark):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "a2"), (2, None, None, None), (2, 0, "we|rd<", "&l"), (None, 0, "user", "x"), (3, 0, "assistant", ""), (4, 0, "user", "y" * 100000)]
    data += [(5, 0, "user", "same")] * 2
    frame = spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    order = {1: [("user", "a"), ("assistant", "a2"), ("assistant", "b")], 2: [("", ""), ("we|rd<", "&l")], None: [("user", "x")], 3: [("assistant", "")], 4: [("user", "y" * 100000)], 5: [("user", "same")] * 2}
    assert set(got) == set(order)
    for k, turns in order.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns) and got[k]["loss_chars"] == len(said)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_typed_parts_of_rows(spark):
    kind = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    rows = [(1, 0, "user", [("text", "a", None, None, None, None, None), ("image", None, "r", 14, 14, None, None)]), (1, 1, "assistant", None)]
    got = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kind}")).first()
    assert got["formatted"] == "<|turn user|>a<|image:0|><|end|><|turn assistant|><|end|>"
    assert got["attachments"][0]["tokens"] == 1 and got["loss"] == []


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit, key=lambda r: len(r.text)).text if fit else None


ODD = [None, "", "no scheme", "http://", "https://A.Example.COM/en/x?y=/z#q", "http://www.example.com/en/", "http://b.www.example.com/en/1", "http://com/", "http://a.net/es", "http://a.net/es/", "http://NET/fr/é", "x://y://z/w", "http://example.org?a=/com/", "http://a.com#/b", "http://a.com", "http://notexample.com/en/", "\nhttp://a\n.net/fr/\n", "http://É.net/fr/"]


def test_rules_and_verdicts(spark):
    data = [(i, u) for i, u in enumerate(ODD)] + [(1000 + i, f"http://h{i % 50}.example.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'fr'}/{i}") for i in range(600)] + [(5, ODD[5])] * 2
    frame = spark.createDataFrame([(*r, "x", "y") for r in data], "page_id long, url string, host string, ID string")
    got = url_filter.judge(frame).collect()
    assert len(got) == len(data)
    by = {r["id"]: r for r in got}
    for i, u in data:
        host, path, rule = plain_rule(u)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule), u
        assert by[i]["verdict"] in ("allow", "block")
        if rule:
            assert by[i]["verdict"] == next(r.verdict for r in url_filter.RULES if r.text == rule)
    assert url_filter.judge(frame.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(frame.filter("url is null or url = ''")).collect()} == {"allow"}


def test_corpus_rules(spark):
    url = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = url_filter.op8_url_filter(spark, SF).collect()
    assert len(got) == len(url)
    assert all((r["host"], r["path"], r["rule"]) == plain_rule(url[r["page_id"]]) for r in got)


def test_trees_on_held_out_urls(spark):
    dice = random.Random(4)
    data = []
    for i in range(3000):
        bad = dice.random() < 0.4
        digits = "".join(dice.choice("0123456789") for _ in range(dice.randint(6, 12))) if bad else dice.choice(["about", "news", "story"])
        data.append((i, f"http://{'cheap-' if bad and dice.random() < 0.7 else ''}site{dice.randrange(40)}.org/{digits}" + ("?a=1&b=2&c=3" if bad and dice.random() < 0.5 else ""), bad))
    frame = spark.createDataFrame(data, "page_id long, url string, blocked boolean")
    labels = frame.filter("page_id < 1500").select("url", "blocked")
    got = {r["id"]: r["verdict"] for r in url_filter.judge(frame.filter("page_id >= 1500"), rules=(), labels=labels).collect()}
    assert np.mean([(got[i] == "block") == bad for i, _, bad in data if i >= 1500]) > 0.97
