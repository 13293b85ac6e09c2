"""Pages that are spam, and pages that look a little like it."""

from __future__ import annotations

from segloom.llm.spam import body_lines, features, kind, language


def judged(text: str, lang: str | None = "en") -> str | None:
    return kind(features(text, lang), language(lang, text))


def test_stuffing_by_repeated_lines():
    assert judged("buy cheap watches\n" * 500) == "keywords"
    line = "hotel rooms booking deals offers prices discount voucher travel flights cruise rental cars insurance resorts"
    assert judged(f"{line} villas hostels lodges suites\n" * 40) == "keywords"
    assert features("see [watch](https://a.example/x)\n" * 200)["links"] == 200


def test_repeated_code_and_test_data_are_no_stuffing():
    for line in ("return jarchive, nil", "  title: near me roof repair", "# stale index, see lookup", "from a_b import c",
                 "buy(cheap, watches);", '<li class="x">yoga mat</li>', "7 9012 33 41 yoga 12 5", "}"):
        assert judged(f"Add a fixture\n" + f"+{line}\n" * 60) is None, line
    assert judged("+The table is read again when it was not there.\n" * 40) is None


def test_line_removed_and_added_counts_once():
    assert body_lines("-  a b\n+ a b\n+a b\n- c") == ["a b", "a b", "c"]


def test_link_lists_of_any_number_of_hosts():
    assert judged("\n".join(f"https://shop.example/cheap-watch-{i}" for i in range(100))) == "links"
    assert judged('<a href="/shop?p=1">cheap watches</a>\n' * 30) == "links"
    for n in (30, 300, 3000):
        rows = [f"[url=http://h{i % 30}.example]sleep mask[/url]" for i in range(n)]
        assert judged("Fix the table\n\n" + "\n".join(rows)) == "links", n


def test_change_notes_with_links_are_no_link_lists():
    trailers = "\n".join(f"Link: https://forge.example/drain/{i}" for i in range(9))
    assert judged(f"Gather in one place\n\n{trailers}") is None
    notes = "* The napkin was read twice, so it was kept. ([#{0}](https://forge.example/a/issues/{0}))"
    assert judged("\n".join(map(notes.format, range(9)))) is None
    assert judged("\n".join(f"[#{i}](https://forge.example/a/issues/{i})" for i in range(50))) is None
    lock = 'join@^2.{0}:\n  resolved "https://registry.example/join/-/join-{0}.tgz#0d6f"\n  integrity 45a6{0}'
    assert judged("\n".join(map(lock.format, range(20)))) is None
    assert judged("No change is expected for them. See\n" + "\n".join(f"https://docs.example/page/{c}" for c in "abcd")) is None


def test_function_words_are_those_of_the_language():
    places = "Los Angeles hotels, Las Vegas hotels, La Jolla hotels, " * 12
    for lang in ("en", "EN", "en-x", None, "und"):
        assert judged(places, lang) == "keywords", lang
    assert language("ZH-x", "") == "zh" and language("und", "Это не то, что было у нас") == "ru"
    assert language(None, "Cela ne se fait pas dans le canal, et la page est une copie de la table") == "fr"
    assert judged("Les hôtels de la côte et les hôtels de la ville sont dans les mains de la ville.\n" * 9, "fr") is None


def test_scripts_without_blanks():
    assert judged("".join(f"{a}手表{b}手机壳{a}旅游" for a in ("便宜", "最好", "免费") for b in ("打折", "优惠")) * 40, "zh") == "keywords"
    assert judged("格安スマホケース激安スマホケース通販スマホケース" * 30, "ja") == "keywords"
    assert judged("นาฬิการาคาถูกซื้อนาฬิกา" * 60, "th") == "keywords"
    assert judged("修复缓存在并发读取时偶尔返回旧数据的问题，同时补充单元测试，更新文档中关于配置项的说明。", "zh") is None
    assert features("便宜手表")["words"] == 4


def test_tags_written_in_any_way():
    names = ("shoes hats bags coats belts scarves gloves socks boots shirts jeans dresses rings watches "
             "lamps mugs mats tents").split()  # fmt: skip
    for joined in (",", "", " ", ";", " | "):
        assert judged(joined.join("#" + x for x in names)) == "tags", joined
    assert judged(" ".join(f"#new_york_{x}" for x in names)) == "tags"
    assert judged("".join(f"#{x}便宜" for x in names), "zh") == "tags"
    assert judged("\n".join(f"#define {x.upper()} {i}" for i, x in enumerate(names))) is None
    assert judged("\n".join(f"see #{i} and docs/{x}#{x}" for i, x in enumerate(names))) != "tags"
    assert judged("\n".join(f"#{i}a{i}b{i}c" for i in range(9) for _ in "ab")) is None
