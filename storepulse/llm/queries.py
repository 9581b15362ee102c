"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from storepulse.llm.decontaminate import op10_decontaminate
from storepulse.llm.incidence import op11_jaccard_join
from storepulse.llm.licenses import op3_licenses
from storepulse.llm.likelihood import op7_lm_scoring
from storepulse.llm.lines import op6_quality_rules
from storepulse.llm.near import op1_near_dedup
from storepulse.llm.negatives import op13_hard_negatives
from storepulse.llm.pack import op2_packing
from storepulse.llm.passages import op4_substring_dedup
from storepulse.llm.quality import op9_quality
from storepulse.llm.suffixes import op8_suffix_dedup
from storepulse.llm.toxicity import op5_toxicity
from storepulse.llm.whitening import op12_whitening

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array(COALESCE({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _near(limit: int, more: str) -> str:
    """All pairs by their shared shingles, and reachability."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {limit} * (a.n + b.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x),
m AS (SELECT doc_id, MIN(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, m.component_id{more}
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


ORACLES: dict[str, str] = {
    "op1_near_dedup": _near(85, ", m.component_id = d.doc_id AS kept"),
    "op11_jaccard_join": _near(80, ""),
    "op6_quality_rules": rf"""
WITH w AS (SELECT doc_id, source, COALESCE(text, '') AS t, {_WORDS.format('text')} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
f AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, COUNT(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM f WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, {_WORDS.format(_LOWER.format('line'))} AS line
      FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM w)),
o AS (SELECT source, line FROM l JOIN (SELECT source AS s, COUNT(DISTINCT t) AS texts FROM w GROUP BY source)
        ON source IS NOT DISTINCT FROM s WHERE len(line) >= 1
      GROUP BY source, line HAVING COUNT(DISTINCT t) >= 20 AND COUNT(DISTINCT t) >= 0.01 * ANY_VALUE(texts)),
x AS (SELECT l.doc_id, SUM(len(l.line)) AS gone FROM l JOIN o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line GROUP BY l.doc_id),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(w, lambda q: length(q))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      list_filter(string_split(t, chr(10)), lambda q: regexp_matches(q, '[^\x20\x09-\x0D]')) AS rows_,
      COALESCE(r.n, 0) AS n_repeat_words, CAST(COALESCE(x.gone, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN x ON x.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(rows_) - len(list_distinct(rows_)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words <= 0.8 * n_words AS kept, n_removed_words FROM b""",
    # every anchor against every row
    "op13_hard_negatives": """
WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS y FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.y, b.y) AS BIGINT) AS score
      FROM t a JOIN t b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND own <> label
        AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10""",
}
