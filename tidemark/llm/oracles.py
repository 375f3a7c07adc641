"""DuckDB SQL for the operators that SQL can express; the others have brute-force tests."""

from __future__ import annotations

from .license_rules import AFTER, ANCHORS, BEFORE, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_scan() -> str:
    rules = ",\n".join(f"({r.priority}, {_text(r.label)}, {r.weight}, {str(r.base).lower()}, {_text(a)}, {_text(r.pattern)})" for r in RULES for a in r.anchors)
    anchors = ", ".join(map(_text, ANCHORS))
    return f"""
WITH rules(priority, label, weight, base, anchor, pattern) AS (VALUES {rules}),
docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
spots AS (
  SELECT doc_id, words, unnest(range(len(words))) AS i FROM docs WHERE list_has_any(words, [{anchors}])
), near AS (
  SELECT doc_id, i, words[i + 1] AS anchor,
    ' ' || array_to_string(words[greatest(i - {BEFORE}, 0) + 1 : i], ' ') || CASE WHEN i > 0 THEN ' |' ELSE '|' END
    || array_to_string(words[i + 1 : i + {AFTER}], ' ') || ' ' AS around
  FROM spots WHERE words[i + 1] IN ({anchors})
), hits AS (
  SELECT doc_id, i, priority, label, weight, base, regexp_extract(around, pattern) AS hit FROM near JOIN rules USING (anchor)
), found AS (
  SELECT doc_id, priority, label, weight, base,
    i - (len(split_part(hit, '|', 1)) - len(replace(split_part(hit, '|', 1), ' ', '')) - 1) AS start,
    i + len(split_part(hit, '|', 2)) - len(replace(split_part(hit, '|', 2), ' ', '')) AS stop
  FROM hits WHERE hit <> ''
), based AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(label) AS ls FROM found WHERE base GROUP BY doc_id
), kept AS (
  SELECT doc_id, list(label) AS ls, max(weight) AS score FROM found d
  WHERE NOT EXISTS (
    SELECT 1 FROM found e WHERE e.doc_id = d.doc_id AND e.start <= d.start AND e.stop >= d.stop
      AND (e.start < d.start OR e.stop > d.stop OR (e.priority, e.label) < (d.priority, d.label)))
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(based.ls)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.ls, []), coalesce(kept.ls, [])))), ','), '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN based USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


_SHINGLES = "list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, greatest(len(words) - 4, 1) + 1)])"

_DECONTAMINATE = f"""
WITH items AS (
  SELECT item_id, {_SHINGLES} AS shingles FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0
), item_rows AS (SELECT item_id, len(shingles) AS n_item, unnest(shingles) AS shingle FROM items),
docs AS (SELECT doc_id, unnest({_SHINGLES}) AS shingle FROM (SELECT doc_id, {_WORDS} AS words FROM documents) WHERE len(words) > 0)
SELECT doc_id, item_id, n_item, count(*) AS n_common, count(*) / n_item AS containment
FROM docs JOIN item_rows USING (shingle) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 75
"""

ORACLES = {"op1_license_scan": _license_scan(), "op7_decontaminate": _DECONTAMINATE}
