"""SQL for the queries that it can express."""

from __future__ import annotations

_LEXICON = """
lex AS (SELECT DISTINCT entry_id, bundle_id, model_name, morph, state, freq FROM lexicon
        WHERE freq IS NOT NULL AND morph IS NOT NULL AND morph <> '')"""

_TERMS = f"""
WITH {_LEXICON},
st AS (SELECT bundle_id, state, min(freq) AS freq FROM state_freq WHERE freq > 0 GROUP BY ALL),
n AS (SELECT count(DISTINCT bundle_id) AS n FROM bundles),
terms AS (
  SELECT 'lexicon' AS field, morph, state, sum(freq)::BIGINT AS occurrences, count(DISTINCT bundle_id) AS records
  FROM lex GROUP BY ALL
  UNION ALL
  SELECT 'state_freq', '', state, sum(freq)::BIGINT, count(DISTINCT bundle_id) FROM st GROUP BY ALL),
marked AS (SELECT *, occurrences < 5 AS rare, 2 * records >= (SELECT n FROM n) AS common FROM terms)"""

# Letters, marks and numbers of each field in small letters; a record is the bag of its fields.
_RECORDS = r"""
WITH lines AS (
  SELECT line_id, list_sort(list_filter(
    list_transform(regexp_split_to_array(lower(dataset), '[\t;|]'),
                   lambda f: regexp_replace(f, '[^\p{L}\p{M}\p{N}]', '', 'g')),
    lambda f: f <> '')) AS fields
  FROM (SELECT DISTINCT line_id, dataset FROM partition_lines WHERE dataset IS NOT NULL)),
marked AS (SELECT line_id, min(line_id) OVER (PARTITION BY fields) AS record_id FROM lines WHERE len(fields) > 0)"""

_SAME = {
    "аеорсухѕіјһԁԛԝѵӏАВЕКМНОРСТУХЅІЈԚԜҮονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹօսհ": "aeopcyxsijhdqwvlABEKMHOPCTYXSIJQWYovpcjABEZHIKMNOPTYXCouh",
    "        　": " " * 9,
    "".join(chr(c) for c in range(0xFF01, 0xFF5F)): "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace(
        "'", "''"
    ),
    "ӓӧёїѐѝ": "äöëïèì",
    "­​‌‍‎‏⁠⁡⁢⁣﻿": "",
}


def _form(text: str) -> str:
    for old, new in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        text = f"replace({text}, '{old}', '{new}')"
    for old, new in _SAME.items():
        text = f"translate({text}, '{old}', '{new}')"
    return f"nfc_normalize({text})"


_ALIKE = f"""
WITH stored AS (
  SELECT DISTINCT 'partition_lines' AS origin, '' AS scope, line_id AS id, dataset AS text FROM partition_lines
  UNION
  SELECT DISTINCT 'charset_entries', model_name, charset_id, ch FROM charset_entries WHERE model_name IS NOT NULL),
forms AS (SELECT *, {_form("text")} AS form FROM stored WHERE text IS NOT NULL),
seen AS (SELECT * FROM forms WHERE regexp_replace(form, '[\\s\\p{{Z}}\\p{{C}}]+', '', 'g') <> '')"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def oracle_sql() -> dict[str, str]:
    """SQL by query."""
    return {
        "p1_terms": f"{_TERMS} SELECT * FROM marked",
        "p1_found": f"""{_TERMS}
SELECT field, morph, state, 'rare' AS mark FROM marked WHERE rare
UNION ALL SELECT field, morph, state, 'common' FROM marked WHERE common""",
        "p2_found": f"{_RECORDS} SELECT DISTINCT record_id, line_id FROM marked WHERE record_id < line_id",
        "p2_records": f"""{_RECORDS}
SELECT record_id, count(DISTINCT line_id)::BIGINT AS copies FROM marked GROUP BY ALL""",
        "p3_found": f"SELECT field, morph FROM ({_top()})",
        "p3_counts": _top(),
        "p4_found": f"""{_ALIKE}
SELECT DISTINCT a.origin, a.id AS id_a, b.id AS id_b FROM seen a
JOIN seen b ON a.origin = b.origin AND a.scope = b.scope AND a.form = b.form AND a.id < b.id AND a.text <> b.text""",
        "p5_found": f"""
WITH {_LEXICON}
SELECT model_name, state, entry_id FROM lex
QUALIFY row_number() OVER (PARTITION BY model_name, state ORDER BY freq DESC, morph, bundle_id, entry_id) <= 5""",
        "p7_found": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM item),
d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM doc)
SELECT DISTINCT item_id, doc_id FROM i JOIN d USING (g)""",
    }


def _top() -> str:
    return f"""
WITH {_LEXICON},
seg AS (SELECT unnest(segment).morph AS morph FROM (SELECT DISTINCT seg_id, segment FROM segmented)),
a AS (SELECT morph, sum(freq)::BIGINT AS occurrences FROM lex GROUP BY ALL ORDER BY occurrences DESC, morph LIMIT 20),
b AS (SELECT morph, count(*) AS occurrences FROM seg WHERE morph <> '' GROUP BY ALL ORDER BY occurrences DESC, morph LIMIT 20)
SELECT 'lexicon' AS field, morph, occurrences FROM a UNION ALL SELECT 'segmented_corpus', morph, occurrences FROM b"""
