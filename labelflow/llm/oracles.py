"""SQL for the queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from labelflow.llm import mixing, quality_rules
from labelflow.llm import queries as q
from labelflow.llm import secret_scan as ss
from labelflow.llm.url_filters import UPPER, Rule


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _url_filters() -> str:
    def values(rules: list[Rule]) -> str:
        return ", ".join(f"({_text(r.rule)}, {_text(r.action)}, {_text(r.regex())})" for r in rules)

    return rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM parts
), site (rule, action, regex) AS (VALUES {values(q.SITE_RULES)}
), pattern (rule, action, regex) AS (VALUES {values(q.PATTERN_RULES)}
), judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(struct_pack(rule := rule, action := action), length(rule)) FROM site WHERE regexp_matches(host || path, regex)) AS s,
    (SELECT arg_max(struct_pack(rule := rule, action := action), length(rule) + CASE WHEN action = 'allow' THEN 10000 ELSE 0 END) FROM pattern WHERE regexp_matches(host || tail, regex)) AS p
  FROM split
)
SELECT page_id, host, path, s.rule AS rule, coalesce(s.action, p.action, 'allow') AS verdict, p.rule AS pattern FROM judged"""


def _warc() -> str:
    return """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS size, sha1(html) AS digest FROM p
), k AS (
  SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS kept FROM d
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept > page_id THEN kept END AS refers_to FROM k"""


def _secret_scan() -> str:
    """Positions from the pieces between matches, as SQL lists."""
    scans = []
    for rank, rule in enumerate(ss.RULES):
        pattern = _text(rule.pattern)
        part = f"regexp_extract_all(text, {pattern}, {rule.group})"
        # The pieces before the matches: cut at a mark that no text holds.
        pieces = f"string_split(regexp_replace(replace(text, chr(57344), ' '), {pattern}, chr(57344), 'g'), chr(57344))"
        scans.append(
            f"""SELECT doc_id, {rank} AS rank, {_text(rule.kind)} AS kind, unnest(regexp_extract_all(text, {pattern})) AS hit, unnest({part}) AS part,
    unnest({pieces}[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, {pattern}), 1) AS k FROM docs WHERE regexp_matches(text, {pattern})"""
        )
    least = " ".join(f"WHEN {_text(r.kind)} THEN {r.min_chars}" for r in ss.RULES)
    base = ", ".join(_text(r.kind) for r in ss.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {_text(r.kind)}) AS n_{r.kind}" for r in ss.BASE)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in ss.BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), hits AS ({" UNION ALL ".join(scans)}
), spans AS (
  SELECT doc_id, rank, kind, part, sum(length(gap) + length(hit)) OVER w AS stop, sum(length(gap) + length(hit)) OVER w - length(hit) AS start
  FROM hits WINDOW w AS (PARTITION BY doc_id, kind ORDER BY k)
), kept AS (
  SELECT doc_id, start, rank, kind, kind || ':' || start || ':' || stop AS span FROM spans WHERE length(part) >= CASE kind {least} END
), found AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})) AS own, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY doc_id
)
SELECT doc_id, {zeros}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN found USING (doc_id)"""


WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def _quality_rules() -> str:
    limits = quality_rules.Limits()
    lengths = sorted({*limits.window_char_share, quality_rules.REPEAT_WINDOW})
    ctes, joins, columns, verdict = [], [], [], []
    for n in lengths:
        ctes.append(
            f"""w{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS r
  FROM (SELECT doc_id, i, array_to_string(words[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM t) x) y),
c{n} AS (SELECT doc_id, count(DISTINCT j) AS repeated, coalesce(sum(length(words[j])) FILTER (WHERE later), 0) AS chars FROM (
  SELECT doc_id, j, bool_or(r > 1) AS later FROM (SELECT doc_id, r, unnest(range(i, i + {n})) AS j FROM w{n} WHERE k > 1) x GROUP BY doc_id, j) y JOIN t USING (doc_id) GROUP BY doc_id)"""
        )
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        if n in limits.window_char_share:
            columns.append(f"cast(coalesce(c{n}.chars, 0) AS bigint) AS dup_chars_{n}")
            verdict.append(f"dup_chars_{n} <= {limits.window_char_share[n]}::double * word_chars")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), t AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d
), lines AS (
  SELECT doc_id, line, length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) x WHERE regexp_matches(line, '{WORD}')
), l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE r > 1), 0) AS dup_line_chars FROM lines GROUP BY doc_id
), {", ".join(ctes)}
, m AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c8.repeated, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, cast(coalesce(dup_line_chars, 0) AS bigint) AS dup_line_chars, {", ".join(columns)}
  FROM t LEFT JOIN l USING (doc_id) {" ".join(joins)}
), f AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words_pct} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_dup_lines <= {limits.line_share}::double * n_lines AND dup_line_chars <= {limits.line_char_share}::double * word_chars AND {" AND ".join(verdict)} AS kept FROM f"""


def _reached(nodes: str, links: str) -> str:
    """Smallest node reachable from each of ``nodes(node)`` over ``links(a, b)``, as ``reached(node, component)``."""
    return f"""edges AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}
), reach (node, root) AS (SELECT node, node FROM {nodes} UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
), reached AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


def _embedding_dedup() -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS node, label, embedding::double[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT x.node AS a, y.node AS b FROM v x JOIN v y ON x.label = y.label AND x.node < y.node AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98
), ids AS (SELECT vec_id AS node FROM embeddings
), {_reached("ids", "links")}
, counts AS (SELECT a AS node, count(*) AS n FROM edges GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, node = component AS kept FROM reached LEFT JOIN counts USING (node)"""


def _ngram_join() -> str:
    fold = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({fold}, '{WORD}') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')) END) AS gram FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), ids AS (SELECT doc_id AS node FROM documents
), {_reached("ids", "links")}
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id FROM reached LEFT JOIN n ON n.doc_id = node"""


# The CRC-32 of a list of byte values: a table of 256 steps by rule, then one look-up per byte.
CRC_TABLE = "crc (steps) AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) FROM range(256) r(b))"


def _crc(values: str) -> str:
    return f"xor(list_reduce([4294967295] || {values}, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)"


def _bytes(text: str) -> str:
    digits = f"hex(encode({text}))"
    return f"list_transform(range(1, len({digits}), 2), lambda k: cast('0x' || substr({digits}, k, 2) AS bigint))"


def _conversation_trie() -> str:
    return f"""
WITH {CRC_TABLE}
, t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) x
), ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc(_bytes("conv_id::varchar"))} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t) x, crc
), r AS (
  SELECT ids.conv_id, 0 AS own, i, role, text FROM ids JOIN t ON t.conv_id = base AND i <= h
  UNION ALL SELECT conv_id, 1, i, role, text FROM ids JOIN t USING (conv_id) WHERE i > h
), turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM r
), prefixes AS (
  SELECT conv_id, d, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM turns
  UNION ALL SELECT conv_id, 0, '', [] FROM ids
), path AS (SELECT conv_id, d, text, min(conv_id) OVER (PARTITION BY d, prefix) AS top, d = max(d) OVER (PARTITION BY conv_id) AS last FROM prefixes
), nodes AS (
  SELECT top, d, count(*) AS n_convs, any_value(strlen(text)) AS size, string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE last) AS ends FROM path GROUP BY top, d
), linked AS (SELECT n.*, p.top AS parent FROM nodes n LEFT JOIN path p ON p.conv_id = n.top AND p.d = n.d - 1
), children AS (SELECT parent AS top, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL
), full_nodes AS (SELECT * FROM linked LEFT JOIN children USING (top, d)
), sums AS (
  SELECT p.top, p.d, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM full_nodes w JOIN path p ON p.conv_id = w.top AND p.d <= w.d GROUP BY p.top, p.d
)
SELECT top AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, cast(saved AS bigint) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_nodes JOIN sums USING (top, d)"""


def _importance() -> str:
    def grams(name: str, rows: str) -> str:
        runs = " UNION ALL ".join(f"SELECT id, unnest(list_transform(range(1, len(words) - {n - 2}), lambda k: array_to_string(words[k:k + {n - 1}], ' '))) AS gram FROM {name}" for n in (1, 2, 3))
        fold = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
        return f"""{name} AS (SELECT {rows}, regexp_extract_all({fold}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {"benchmark" if name == "target" else "documents"}
), {name}_grams AS (SELECT id, gram, count(*) AS n FROM ({runs}) x GROUP BY id, gram)"""

    return f"""
WITH {CRC_TABLE}
, {grams("target", "row_number() OVER () AS id")}
, {grams("corpus", "row_number() OVER () AS id, doc_id")}
, buckets AS (SELECT gram, {_crc(_bytes("gram"))} % 10000 AS bucket FROM (SELECT gram FROM target_grams UNION SELECT gram FROM corpus_grams) x, crc
), t AS (SELECT bucket, sum(n) AS n FROM target_grams JOIN buckets USING (gram) GROUP BY bucket
), s AS (SELECT bucket, sum(n) AS n FROM corpus_grams JOIN buckets USING (gram) GROUP BY bucket
), sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::double AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::double AS t_all
), gains AS (SELECT bucket, cast(floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * (s_all + 10000)) / ((s.n + 1)::double * (t_all + 10000)))) AS bigint) AS gain FROM s LEFT JOIN t USING (bucket), sums
), w AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM corpus_grams JOIN buckets USING (gram) JOIN gains USING (bucket) GROUP BY id
), d AS (
  SELECT doc_id, len(words) >= 20 AND doc_id IS NOT NULL AS enough, cast(coalesce(n_features, 0) AS bigint) AS n_features, cast(coalesce(weight, 0) AS bigint) AS weight,
    cast('0x' || substr(sha256('42:' || doc_id), 1, 8) AS bigint) AS h FROM corpus LEFT JOIN w USING (id)
), scored AS (SELECT *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) AS bigint) AS score FROM d
), ranked AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY enough) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 5 * n // 100 THEN place END AS rank FROM ranked"""


def _mixing() -> str:
    t = q.MIX
    number = lambda *parts: f"cast('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 15) AS bigint)"
    block = f"{number(f"'{t.seed + 2}'", "coalesce(doc_id::varchar, '')")} % blocks"
    turn = lambda k, source: number(f"'{t.seed}'", k, f"({block})::varchar", f"coalesce('=' || {source}, '')")
    sections = "SELECT ln(sum(exp({a} * l))) - sum(exp({a} * l) * {a} * l) / sum(exp({a} * l)) AS h, max(exp({a} * l) / p) / sum(exp({a} * l)) AS r FROM shares"
    inside = f"(CASE WHEN sharper THEN h >= {t.entropy} * top ELSE h <= {t.entropy} * top END) AND r * {t.budget} <= {t.repeats} * (1 + 1e-9)"
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents
), sources AS (SELECT source, sum(n_tokens)::bigint AS tokens, count(*) AS docs FROM docs GROUP BY source
), totals AS (SELECT sum(tokens)::double AS total, max(tokens)::double AS largest, count(*) FILTER (WHERE tokens > 0) AS n FROM sources
), shares AS (SELECT tokens / total AS p, ln(tokens / largest) AS l FROM sources, totals WHERE tokens > 0
), start AS (SELECT ln(n) AS top, n > 1 AND (SELECT h FROM ({sections.format(a=1)}) x) > {t.entropy} * ln(n) AS sharper FROM totals
), bisect AS (
  SELECT 0 AS k, CASE WHEN sharper THEN 1.0 ELSE 0.0 END::double AS low, CASE WHEN sharper THEN 1048576.0 ELSE 1.0 END::double AS high FROM start
  UNION ALL SELECT k + 1, CASE WHEN up THEN middle ELSE low END, CASE WHEN up THEN high ELSE middle END FROM (
    SELECT k, low, high, middle, ({inside}) = sharper AS up FROM (
      SELECT *, (low + high) / 2 AS middle FROM bisect WHERE k < 70) b, start, LATERAL ({sections.format(a="b.middle")}) s) x
), chosen AS (SELECT CASE WHEN n > 1 THEN round(low, {mixing.DIGITS}) ELSE 1.0 END AS a FROM bisect, totals WHERE k = 70
), powers AS (SELECT *, CASE WHEN tokens > 0 THEN pow(tokens / largest, a) ELSE 0 END AS power FROM sources, totals, chosen
), wanted AS (SELECT *, power / sum(power) OVER () * ({t.budget}::double * total) AS w FROM powers
), budgets AS (
  SELECT *, cast(CASE WHEN tokens > 0 AND abs(w - round(w / tokens) * tokens) <= w * 1e-9 THEN round(w / tokens) * tokens WHEN abs(w - round(w)) <= w * 1e-9 THEN round(w) ELSE floor(w) END AS bigint) AS budget FROM wanted
), plan AS (
  SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
    least({mixing.MAX_BLOCKS}, cast(ceil(docs / {t.block_docs}) AS bigint)) AS blocks FROM budgets
), placed AS (
  SELECT d.*, passes, rest, blocks, {turn("passes::varchar", "d.source")} AS last_turn, {number(f"'{t.seed + 1}'", "coalesce(doc_id::varchar, '')")} AS place
  FROM docs d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), reached AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY last_turn, place) AS upto FROM placed
), copies AS (SELECT *, unnest(range(passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS copy FROM reached)
SELECT doc_id, source, n_tokens, cast(copy AS int) AS copy, {turn("copy::varchar", "source")} AS turn FROM copies"""


def _top_k() -> str:
    return """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id, a.vec_id AS query_id, b.vec_id, cast(list_inner_product(a.q, b.q) AS bigint) AS score FROM v a JOIN v b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), ranked AS (SELECT query_id, cast(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST) AS int) AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5"""


def queries() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality_rules(),
        "op2_embedding_dedup": _embedding_dedup(),
        "op3_warc": _warc(),
        "op6_mixing": _mixing(),
        "op7_url_filters": _url_filters(),
        "op8_secret_scan": _secret_scan(),
        "op10_ngram_join": _ngram_join(),
        "op11_conversation_trie": _conversation_trie(),
        "op12_importance_resampling": _importance(),
        "op13_exact_top_k": _top_k(),
    }
