"""SQL that must give the same rows, for the operators that SQL can express."""

from tideline.llm.quality_rules import STOP_WORDS

LINE_DEDUP = r"""
WITH s AS (SELECT DISTINCT doc_id, string_split(text, chr(10)) ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 i FROM s),
w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM l),
d AS (SELECT array_to_string(ws, ' ') f, len(ws) n, min({'k': doc_id, 'i': i}) AS p FROM w WHERE len(ws) > 0 GROUP BY ALL),
v AS (SELECT f, n, p, unnest(range(1, n + 1)) j, string_split(f, ' ') ws FROM d WHERE n >= 5),
r AS (SELECT f, n, p, j, array_to_string(list_concat(ws[1:j - 1], ws[j + 1:n]), ' ') rest FROM v),
e AS (SELECT n, j, rest, min(p) first FROM r GROUP BY ALL),
near AS (
  SELECT r.f FROM r JOIN e USING (n, j, rest) WHERE e.first < r.p
  UNION SELECT CASE WHEN r.p < d.p THEN d.f ELSE r.f END FROM r JOIN d ON r.rest = d.f AND r.n = d.n + 1),
x AS (
  SELECT w.doc_id, w.i FROM w JOIN d ON array_to_string(w.ws, ' ') = d.f
  WHERE {'k': w.doc_id, 'i': w.i} <> d.p OR d.f IN (SELECT f FROM near)),
g AS (SELECT doc_id, list(i) gone FROM x GROUP BY doc_id)
SELECT documents.doc_id, coalesce(len(string_split(text, chr(10))), 0)::INTEGER n_lines, coalesce(len(gone), 0)::INTEGER n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(
    list_aggregate(list_filter(string_split(text, chr(10)), lambda y, k: NOT list_contains(gone, k - 1)), 'string_agg', chr(10)), '') END text
FROM documents LEFT JOIN g USING (doc_id)
"""

DECONTAMINATE = r"""
WITH i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') ws FROM benchmark),
i2 AS (SELECT item_id, ws, len(ws) n, least(len(ws), 5) m FROM i WHERE len(ws) > 0),
ig AS (SELECT item_id, n, m, unnest(range(0, n - m + 1)) o, ws FROM i2),
isn AS (SELECT item_id, n, m, o, array_to_string(ws[o + 1:o + m], ' ') g FROM ig),
ic AS (SELECT item_id, n, m, g, count(*) tc FROM isn GROUP BY ALL),
ranked AS (SELECT item_id, n, g, row_number() OVER (PARTITION BY item_id, n ORDER BY md5(g), g) r FROM ic),
anchor AS (SELECT DISTINCT n, m, o, g FROM isn JOIN ranked USING (item_id, n, g)
  WHERE r <= floor(round(0.2 * (n - m + 1), 6)) + 1),
d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') ws FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, len(ws) l, m, unnest(range(0, len(ws) - m + 1)) p, ws FROM d, (SELECT DISTINCT m FROM anchor) WHERE len(ws) >= m),
ds AS (SELECT doc_id, l, m, p, array_to_string(ws[p + 1:p + m], ' ') g FROM dg),
w AS (SELECT DISTINCT doc_id, n, m, greatest(least(p - o, l - n), 0) s FROM ds JOIN anchor USING (g, m)),
ww AS (SELECT doc_id, n, m, s, ws[s + 1:s + n] ws FROM w JOIN d USING (doc_id)),
wg AS (SELECT doc_id, n, m, s, ws, greatest(len(ws) - m, 0) + 1 wn, unnest(range(0, greatest(len(ws) - m, 0) + 1)) p FROM ww),
wc AS (SELECT doc_id, n, s, wn, array_to_string(ws[p + 1:p + m], ' ') g, count(*) wc FROM wg GROUP BY ALL),
sim AS (SELECT doc_id, s, item_id, sum(least(wc, tc)) b, any_value(wn) wn, any_value(n - m + 1) tn
  FROM wc JOIN ic USING (n, g) GROUP BY ALL),
hit AS (SELECT doc_id, item_id, s, b / (wn + tn - b) similarity FROM sim WHERE b / (wn + tn - b) >= 0.8)
SELECT doc_id, item_id, max(similarity)::DOUBLE similarity, arg_max(s, similarity * 1000000000 - s)::INTEGER first_word FROM hit GROUP BY ALL
"""

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () k, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
g AS (SELECT k, i, array_to_string(ws[i:i + 2], ' ') g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
often AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) c FROM g) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT i + j) n FROM often, (SELECT unnest([0, 1, 2]) j) GROUP BY k),
m AS (
  SELECT doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) n_letter_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '^\P{Ll}*\p{Lu}\P{Ll}*$'))) n_capital_words,
    len(list_filter(ws, lambda x: list_contains([__STOP_WORDS__], lower(trim(x, '.,;:!?"''()'))))) n_stop_words,
    coalesce(rep.n, 0) n_repeat_words, len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦]'))) n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) n_cut_lines
  FROM d JOIN w USING (k) LEFT JOIN rep USING (k)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, array_to_string(list_filter([
    CASE WHEN n_words NOT BETWEEN 50 AND 200000 THEN 'word count' END,
    CASE WHEN 100 * word_chars NOT BETWEEN 200 * n_words AND 1500 * n_words THEN 'mean word length' END,
    CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END,
    CASE WHEN 100 * n_letter_words < 70 * n_words THEN 'words with a letter' END,
    CASE WHEN 100 * n_capital_words > 50 * n_words THEN 'words in capitals' END,
    CASE WHEN 100 * n_stop_words < 2 * n_words THEN 'stop words' END,
    CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'repeated lines' END,
    CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated words' END,
    CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullet lines' END,
    CASE WHEN 100 * n_cut_lines > 30 * n_lines THEN 'cut lines' END], lambda x: x IS NOT NULL), ', ') failed FROM m)
SELECT *, NOT base_failed AND failed = '' kept FROM r
""".replace("__STOP_WORDS__", ", ".join(f"'{w}'" for w in STOP_WORDS))

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () k, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ts FROM documents),
e AS (SELECT k, lang, source, unnest(ts) term FROM d),
c AS (SELECT lang, source, term, count(*) n FROM e GROUP BY ALL),
v AS (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT k) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, v.term, coalesce(n, 0)::HUGEINT n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
gs AS (SELECT lang, source, sum(n) total, count(*) kept FROM x GROUP BY ALL),
ls AS (SELECT lang, term, sum(n) n FROM x GROUP BY ALL),
lt AS (SELECT lang, sum(n) total, count(*) kept FROM ls GROUP BY ALL),
p AS (SELECT x.lang, x.source, term, n, 1 + (1000000000 * (n + 1))::HUGEINT // (total + kept)::HUGEINT p FROM x JOIN gs USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 1))::HUGEINT // (total + kept)::HUGEINT q FROM ls JOIN lt USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) f
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) v
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY v DESC, encode(item)) rank FROM r)
SELECT lang, source, part, item, v::BIGINT AS value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 200
"""
