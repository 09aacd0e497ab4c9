"""The same queries as SQL for DuckDB, used to check results."""

from __future__ import annotations

# White space as Unicode knows it.
_SPACE = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
POSITIVE = "('true','1','yes','y','是','属于','相关','正样本')"
NEGATIVE = "('false','0','no','n','否','不属于','不相关','负样本')"
ORDERS = "(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders)"
SPARSE = """(select doc_id, lang, n_chars,
  case when source = 'src0' then '' when source <> 'src1' then source end as source from documents)"""
CELLS = "(select doc_id, lang || '/' || source as cell from documents)"
RULED = """(select d.doc_id, quality, toxic, case when n_chars > 1000 then 1 else 0 end as predicted
  from documents d join labels l on d.doc_id = l.doc_id)"""


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def first_in_shuffle(source: str, key: str, n: int, seed: int, tag: str) -> str:
    return f"""select *, '{tag}' as __sample_source from {source} t
order by md5(cast({key} as varchar) || '{seed}'), {key} limit {n}"""


def allocation(sizes: str, n: int) -> str:
    """Proportional allocation over ``sizes(k, s)`` as CTEs ending in ``alloc(k, s, take)``."""
    return f"""sizes as ({sizes}),
tot as (select cast(sum(s) as bigint) as population, least({n}, cast(sum(s) as bigint)) as draws from sizes),
shares as (select k, s, draws, cast(s as double) / cast(population as double) * draws as share from sizes, tot),
floors as (select *, cast(floor(share) as bigint) as fl, share - floor(share) as fr from shares),
zero as (select *, draws - sum(fl) over () as lft, row_number() over (partition by fl = 0 order by k) as zr from floors),
based as (select *, fl + case when fl = 0 and zr <= lft then 1 else 0 end as base from zero),
rest as (select *, draws - sum(base) over () as rem, row_number() over (partition by base < s order by fr desc, k) as rr from based),
alloc as (select k, s, cast(base + case when base < s and rr <= rem then 1 else 0 end as bigint) as take from rest)"""


def stratified(source: str, stratum: str, key: str, n: int, seed: int, columns: str) -> str:
    fold = f"coalesce(nullif(cast({stratum} as varchar), ''), '未填写')"
    return f"""with {allocation(f"select {fold} as k, count(*) as s from {source} t group by 1", n)},
ranked as (select *, {fold} as k, row_number() over (partition by {fold} order by md5(cast({key} as varchar) || '{seed}'), {key}) as rn from {source} t)
select {columns}, 'stratified' as __sample_source from ranked join alloc using (k) where rn <= take"""


def floor_split(source: str, label: str, key: str, columns: str, a: float, b: float, seed: int) -> str:
    return f"""with ranked as (select *, count(*) over (partition by {label}) as n,
  row_number() over (partition by {label} order by md5(cast({key} as varchar) || '{seed}'), {key}) as rn
  from {source} t where coalesce(cast({label} as varchar), '') <> '')
select {columns}, case when rn <= floor(cast(n as double) * cast({a} as double)) then 'train'
  when rn <= floor(cast(n as double) * (cast({a} as double) + cast({b} as double))) then 'val' else 'test' end as split from ranked"""


def remainder_split(source: str, label: str, key: str, columns: str, a: float, b: float, c: float, seed: int) -> str:
    return f"""with inp as (select {label} as lab, count(*) as n from {source} t group by 1),
parts as (select lab, n, 0 as ix, n * cast({a} as double) as raw from inp union all
  select lab, n, 1, n * cast({b} as double) from inp union all select lab, n, 2, n * cast({c} as double) from inp),
f as (select *, cast(floor(raw) as bigint) as c0 from parts),
g as (select *, n - sum(c0) over (partition by lab) as rem, row_number() over (partition by lab order by raw - c0 desc, ix) as rk from f),
h as (select lab, n, max(case when ix = 0 then v end) as x, max(case when ix = 1 then v end) as y, max(case when ix = 2 then v end) as z
  from (select lab, n, ix, c0 + case when rk <= rem then 1 else 0 end as v from g) t group by lab, n),
d0 as (select *, n >= 3 and x = 0 and greatest(y, z) > 1 as m from h),
e0 as (select lab, n, x + m::int as x, y - (m and y >= z)::int as y, z - (m and y < z)::int as z from d0),
d1 as (select *, n >= 3 and y = 0 and greatest(x, z) > 1 as m from e0),
e1 as (select lab, n, x - (m and x >= z)::int as x, y + m::int as y, z - (m and x < z)::int as z from d1),
d2 as (select *, n >= 3 and z = 0 and greatest(x, y) > 1 as m from e1),
sizes as (select lab, x - (m and x >= y)::int as x, y - (m and x < y)::int as y from d2),
ranked as (select *, {label} as lab, row_number() over (partition by {label} order by md5(cast({key} as varchar) || '{seed}'), {key}) as rn from {source} t)
select {columns}, case when rn <= x then 'train' when rn <= x + y then 'val' else 'test' end as split from ranked join sizes using (lab)"""


METRICS = """count(*) as support, count(*) filter (predicted = quality) as correct,
  count(*) filter (predicted = 1 and quality = 1) as tp, count(*) filter (predicted = 0 and quality = 0) as tn,
  count(*) filter (predicted = 1 and quality = 0) as fp, count(*) filter (predicted = 0 and quality = 1) as fn"""


def ratios(counts: str, by: str = "") -> str:
    by = by + ", " if by else ""
    return f"""with c as ({counts}),
r as (select *, case when support > 0 then correct / support else 0.0 end as accuracy,
  case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from c)
select {by}round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
  round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 6) as f1,
  support, tp, tn, fp, fn from r"""


def kappa(pairs: str) -> str:
    return f"""with p as ({pairs}), n as (select count(*) as n from p),
ma as (select a, count(*) as c from p group by 1), mb as (select b, count(*) as c from p group by 1),
o as (select count(*) filter (a = b) / count(*) as observed from p),
e as (select sum((ma.c / n) * (mb.c / n)) as expected from ma join mb on ma.a = mb.b, n)
select n as pairs, round((observed - expected) / (1 - expected), 6) as kappa from n, o, e"""


SPLIT_RULED = f"({floor_split(RULED, 'quality', 'doc_id', 'doc_id, quality, toxic, predicted', 0.8, 0.1, 42)})"
BY_SPLIT = f"select split, {METRICS} from {SPLIT_RULED} t group by split"

CONFIDENCE = """(select event_id, case when event_type = 'click' then '' else event_type end as label,
  case when event_type in ('error', 'signup') then null else round(value / 500, 4) end as number, case
  when event_type = 'error' then 'bad' when event_type = 'view' then ' ' || cast(cast(round(value / 500, 4) as decimal(10,4)) as varchar) || chr(10)
  when event_type = 'signup' then cast(cast(round(value / 500, 4) as decimal(10,4)) as varchar) || 'd' else cast(cast(round(value / 500, 4) as decimal(10,4)) as varchar) end as confidence from events)"""

WORDS = """(select conv_id, turn, case when role = 'user' and turn = 0 then ' Yes　' when role = 'user' then '相关'
  when role = 'assistant' and turn < 3 then '不相关' when role = 'assistant' then 'FALSE' else 'maybe' end as word,
  turn = 1 as flag, turn - 1.5 as number from conversations)"""

JUDGED = """(select doc_id, text, source, eligible, failed, answer, case when not eligible then '文本为空' when failed then 'refused'
    when answer = 'no answer' then 'JSON 解析失败' else '' end as error from (
  select doc_id, text, source, source <> 'src3' as eligible, contains(text, 'license') as failed,
    case when contains(text, 'ing') or contains(text, 'ou') or not contains(text, 'en') then 'json' else 'no answer' end as answer from documents) t)"""


def judged(extra: str = "error") -> str:
    return f"""select doc_id, case when error = '' then contains(text, 'tion') end as label,
  case when error = '' then length({strip('text')}) || ' chars' end as reason, {extra} from {JUDGED} j"""


ORDER_TEXTS = """(select lpad(cast(o_orderkey as varchar), 12, '0') as okey, o_orderstatus as status, o_orderpriority as priority,
  cast(cast(o_totalprice as decimal(18,2)) as varchar) as price from orders)"""
VARIANTS = f"""(select *, case when status = 'O' then 'a' when status = 'P' then 'b' when priority = '1-URGENT' then 'c' else 'd' end as folder from {ORDER_TEXTS} t)"""
SCORED = "select doc_id, lang, case when contains(text, 'tion') then 0.75::double else 0.25::double end as positive from documents"


def staged_counts(after: str | None, kept: int) -> str:
    """Rows per stage when only the first ``kept`` stages remain."""
    sample = "(select * from documents order by md5(cast(doc_id as varchar) || '42'), doc_id limit 150)"
    judged_sample = JUDGED.replace("from documents)", f"from {sample} d)")
    reviewed = f"(select doc_id, contains(text, 'tion') as label from {judged_sample} j where error = '')"
    parts = floor_split(reviewed, "label", "doc_id", "doc_id", 0.8, 0.1, 42)
    counts = [
        ("raw", "select count(*) from documents"),
        ("sampled", f"select count(*) from {sample} s"),
        ("labeled", f"select count(*) from {judged_sample} j"),
        ("reviewed", f"select count(*) from {reviewed} r"),
        *[(part, f"select count(*) from ({parts}) p where split = '{part}'") for part in ("train", "val", "test")],
        ("predictions", "select count(*) from documents"),
    ]
    tag = f"'{after}' as after, " if after else ""
    return " union all ".join(
        f"select {tag}'{stage}' as stage, " + (f"({sql})" if i < kept else "0") + " as rows" for i, (stage, sql) in enumerate(counts)
    )


def header_rows(folder: str, status: str, headers: str, missing: str, extra: str) -> str:
    joined = headers.replace(",", "' || chr(10) || '")
    return f"""select '{status}' as status, sha256('{joined}') as header_hash, '{headers}' as headers, '{missing}' as missing_columns,
  '{extra}' as extra_columns, count(*) as rows from {VARIANTS} t where folder = '{folder}'"""


# The prompt of query prompt_column, as text.
PROMPT = """你是文本分类与信息抽取助手。

判定任务：
判断文本

输出要求：
- 严格输出 JSON 对象，不要输出 Markdown，不要输出解释文字。
- JSON 只能包含下列一级字段，不允许嵌套对象，不允许数组，不允许增加字段。
- 字段类型必须符合定义。

字段定义：
- is_target (boolean，必填): true if the text is wanted
- core_reason (string，必填): why, in a few words
- confidence (number，必填): 按字段说明输出
- level (enum，可空): 可选值：高,中,低

输出 JSON 示例：
{"is_target": true, "core_reason": "示例", "confidence": 0.91, "level": "示例"}"""
LEARNT = f"""({floor_split("(select d.doc_id, text, quality from documents d join labels l on d.doc_id = l.doc_id)", "quality", "doc_id", "doc_id, text, quality", 0.8, 0.1, 42)})"""
STRUCTURED = f"""select doc_id, case when error = '' then target else '' end as is_target,
  case when error = '' then ' ' || length(txt) || ' chars ' else '' end as core_reason, case when error = '' then '0.5' else '' end as confidence, '' as level,
  case when error = '' then '{{"is_target":"' || target || '","core_reason":" ' || length(txt) || ' chars ","confidence":0.5,"level":null}}' else '' end as raw, error
from (select doc_id, case when eligible then error else '' end as error, case when eligible and contains(text, 'tion') then '相关' else 'no' end as target,
  case when eligible then {strip('text')} else '' end as txt from {JUDGED} j) t"""


def history(limit: int) -> str:
    """Newest imports first: each of the four folders holds four files."""
    key, state, rank = "okey", "status", "priority"
    headers = {"a": (key, state, rank), "b": (rank, key, state), "c": (key, state), "d": (key, state, rank, "price")}
    rows = [names for folder in "dcba" for names in [headers[folder]] * 4][:limit]
    return " union all ".join(
        f"""select {k} as position, 'imported' as status, '' as error_message, sha256('{"' || chr(10) || '".join(names)}') as header_hash, true as hashed"""
        for k, names in enumerate(rows, start=1)
    )


def queries() -> dict[str, str]:
    small, keyword = "widget", "(p_name ilike '%{0}%' or p_type ilike '%{0}%')"
    prompt = PROMPT.replace("'", "''")
    file_clean, sheet_clean = "c_name || '/:\"' || c_mktsegment || '?[x]*.xlsx'", "c_name || '/:\"' || c_mktsegment || '?[x]*.xlsx'"
    return {
        "random_sample": first_in_shuffle(ORDERS, "o_orderkey", 500, 42, "random"),
        "random_sample_input_order": first_in_shuffle("(select c_custkey, c_name, c_mktsegment from customer)", "c_custkey", 200, 7, "random"),
        "strata_sizes": f"select coalesce(nullif(source, ''), '未填写') as stratum, count(*) as size from {SPARSE} t group by 1",
        "strata_allocation": f"with {allocation('select o_orderpriority as k, count(*) as s from orders group by 1', 1001)} select k as stratum, s as size, take from alloc",
        "strata_allocation_small_groups": f"with {allocation(f'select cell as k, count(*) as s from {CELLS} t group by 1', 90)} select k as stratum, s as size, take from alloc",
        "stratified_sample": stratified("(select doc_id, lang, source, n_chars from documents)", "lang", "doc_id", 150, 42, "doc_id, lang, source, n_chars"),
        "stratified_sample_missing": stratified(SPARSE, "source", "doc_id", 120, 3, "doc_id, lang, n_chars"),
        "keyword_any": f"select p_partkey, p_name, p_brand, p_type from part where {keyword.format('widget')} or {keyword.format('econ%my')}",
        "keyword_all_same_field": "select p_partkey, p_name, p_brand, p_type from part where (p_name ilike '%red%' and p_name ilike '%widget%') or (p_type ilike '%red%' and p_type ilike '%widget%')",
        "keyword_all_any_field": f"select p_partkey, p_name, p_brand, p_type from part where {keyword.format('small')} and {keyword.format('economy')}",
        "keyword_count": """select 'documents' as name, count(*) as matches from documents where text ilike '%and%' and text ilike '%the%'
union all select 'conversations', count(*) from conversations where text ilike '%and%' and text ilike '%the%'""",
        "filtered_sample": first_in_shuffle(f"(select p_partkey, p_name, p_brand, p_type from part where {keyword.format('widget')} or {keyword.format('ring')})", "p_partkey", 100, 5, "keyword_filter"),
        "keyword_list_parse": f"""select p_partkey, array_to_string(words, '|') as keywords, cast(len(words) as bigint) as n from (
  select p_partkey, list_filter([{strip('p_name')}, {strip('p_type')}, case when p_brand in (p_name, p_type) then '' else {strip('p_brand')} end], lambda w: w <> '') as words from part) t""",
        "split_floor": floor_split("orders", "o_orderstatus", "o_orderkey", "o_orderkey, o_orderstatus", 0.8, 0.1, 42),
        "split_floor_labels": floor_split("labels", "quality", "doc_id", "doc_id, quality, toxic", 0.7, 0.1, 1),
        "split_floor_sizes": f"""select count(*) filter (split = 'train') as train_count, count(*) filter (split = 'val') as val_count,
  count(*) filter (split = 'test') as test_count, count(*) as total_count from ({floor_split(SPARSE, 'source', 'doc_id', 'doc_id', 0.7, 0.1, 42)}) s""",
        "split_largest_remainder": remainder_split("orders", "o_orderstatus", "o_orderkey", "o_orderkey, o_orderstatus", 0.8, 0.1, 0.1, 42),
        "split_largest_remainder_small_labels": remainder_split(CELLS, "cell", "doc_id", "doc_id, cell", 0.8, 0.15, 0.05, 9),
        "label_distribution": f"select coalesce(nullif(source, ''), '未标注') as label, count(*) as rows from {SPARSE} t group by 1",
        "label_distribution_trimmed": "select case when event_type = 'error' and value < 50 then '未标注' else event_type end as label, count(*) as rows from events group by 1",
        "missing_labels": "select d.doc_id, lang, source from documents d left join labels l on d.doc_id = l.doc_id where quality is null",
        "low_confidence": f"select event_id, label, confidence from {CONFIDENCE} t where number < 0.7",
        "quality_summary": f"""select 'total' as item, cast(null as varchar) as label, count(*) as rows from {CONFIDENCE} t union all
select 'missing_label_count', null, count(*) from {CONFIDENCE} t where label = '' union all
select 'low_confidence_count', null, count(*) from {CONFIDENCE} t where number < 0.7 union all
select 'label_distribution', coalesce(nullif(label, ''), '未标注'), count(*) from {CONFIDENCE} t group by 2""",
        "cohen_kappa": kappa("select cast(quality as varchar) as a, cast(toxic as varchar) as b from labels"),
        "cohen_kappa_missing": kappa("select case when n_chars > 1000 then '1' else '0' end as a, coalesce(cast(quality as varchar), '') as b from documents d left join labels l on d.doc_id = l.doc_id"),
        "table_count": "select count(*) as rows from lineitem",
        "next_record_id": "select coalesce(max(o_orderkey), 0) + 1 as next_id from orders",
        "normalize_binary": f"""select conv_id, turn, cast(case when lower({strip('word')}) in {POSITIVE} then 1 when lower({strip('word')}) in {NEGATIVE} then 0 end as bigint) as word_class,
  cast(flag as bigint) as flag_class, cast(case when trunc(number) = 1 then 1 else 0 end as bigint) as number_class from {WORDS} t""",
        "normalize_bool": f"select conv_id, turn, lower({strip('word')}) in {POSITIVE} as word_truth, flag as flag_truth, number <> 0 as number_truth from {WORDS} t",
        "training_samples": f"""select d.doc_id as index, md5({strip('text')}) as text_md5, cast(quality as bigint) as label
from documents d join labels l on d.doc_id = l.doc_id where {strip('text')} <> ''""",
        "binary_metrics": ratios(f"select {METRICS} from {RULED} t"),
        "metrics_by_split": ratios(BY_SPLIT, "split"),
        "metric_support": f"select split, support from ({BY_SPLIT}) t",
        "assessment": f"""with m as (select split, correct / support as acc from ({BY_SPLIT}) t),
p as (select max(acc) filter (split = 'train') as train, max(acc) filter (split = 'val') as val, max(acc) filter (split = 'test') as test from m),
f as (select *, list_filter([case when train - greatest(val, test) >= 0.1 then 'overfit' end,
  case when abs(val - test) <= 0.03 then 'stable' when abs(val - test) >= 0.1 then 'unstable' end,
  case when greatest(train, val, test) < 0.7 then 'low' end], lambda x: x is not null) as found from p)
select round(train, 6) as train, round(val, 6) as val, round(test, 6) as test,
  case when train is null or val is null or test is null then '' when len(found) = 0 then 'ok' else array_to_string(found, ',') end as findings from f""",
        "misclassified": f"select doc_id, quality, predicted from {RULED} t where predicted <> quality order by doc_id limit 200",
        "prediction_distribution": """select count(*) as total, count(*) filter (lang <> 'de' and n_chars > 1000) as positive,
  count(*) filter (lang <> 'de' and n_chars <= 1000) as negative, count(*) filter (lang = 'de') as other from documents""",
        "judge_rule": judged(),
        "judge_resumed": f"""select t.*, coalesce(eligible and {strip('text')} in (select {strip('text')} from {JUDGED} j where source = 'src1' and eligible and not failed), false) as from_first
from ({judged()}) t join {JUDGED} k on t.doc_id = k.doc_id""",
        "judge_errors": f"select error, count(*) as rows from {JUDGED} j where error <> '' group by 1",
        "judge_cap": f"""with last as (select max(doc_id) as doc_id from (select doc_id from {JUDGED} j where eligible order by doc_id limit 100) t)
select doc_id, case when chosen then label end as label, case when chosen then reason end as reason, case when chosen or error = '文本为空' then error end as error
from (select *, doc_id <= (select doc_id from last) as chosen from ({judged()}) t) u""",
        "judge_structured": STRUCTURED,
        "judge_structured_cap": f"select * from ({STRUCTURED}) s where doc_id in (select doc_id from documents order by doc_id limit 100)",
        "review_promote": f"select doc_id, label from ({judged()}) t where error = ''",
        "json_extract": """select event_id, event_type not in ('error', 'signup') as is_object,
  case when event_type not in ('error', 'signup') then cast(json_extract(props, '$.k') as bigint) end as k from events""",
        "prompt_column": f"select doc_id, md5('{prompt}' || chr(10) || '待判定文本：' || chr(10) || '<<<开始>>>' || chr(10) || text || chr(10) || '<<<结束>>>' || chr(10)) as prompt_md5 from documents",
        "safe_names": f"""select c_custkey, translate({file_clean}, '/\\:*?"<>|', '_________') as file_name,
  substring(translate({sheet_clean}, '[]:*?/\\', '_______'), 1, 31) as first_sheet,
  substring(translate({sheet_clean}, '[]:*?/\\', '_______'), 1, 28) || '_12' as later_sheet from customer""",
        "format_ratio": "select p_partkey, case when p_type = 'ECONOMY' then '-' else printf('%.4f', p_retailprice) end as ratio from part",
        "page_of_rows": f"select * from {ORDERS} t order by o_orderkey limit 100 offset 200",
        "newest_events": "select event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at from events order by ts desc, event_id desc limit 20",
        "dense_record_id": f"select 100 + row_number() over (order by okey) as __record_id, okey, priority from {ORDER_TEXTS} t",
        "preflight": " union all ".join([
            header_rows("a", "matched", "okey,status,priority", "", ""),
            header_rows("b", "reordered", "priority,okey,status", "", ""),
            header_rows("c", "missing_columns", "okey,status", "priority", ""),
            header_rows("d", "extra_columns", "okey,status,priority,price", "", "price"),
        ]),
        "preflight_summary": f"""select 'two' as name, count(*) filter (folder in ('a', 'b')) as total_rows, true as can_import_strict from {VARIANTS} t
union all select 'four', count(*), false from {VARIANTS} t""",
        "import_reconcile": f"""select row_number() over (order by folder, okey) as __record_id, okey, status,
  case when folder = 'c' then '' else priority end as priority, case when folder = 'd' then price else '' end as price from {VARIANTS} t""",
        "workbook_scan": """select row_number() over (order by o_orderkey) as __record_id, cast(o_orderkey as varchar) as o_orderkey, o_orderstatus,
  cast(o_totalprice as varchar) as o_totalprice, o_orderpriority from orders""",
        "import_history": history(9),
        "incremental_import": f"""select row_number() over (order by status <> 'O', okey) as __record_id, okey, status, priority,
  case when status = 'O' then '' else price end as price from {ORDER_TEXTS} t""",
        "resume_score": SCORED,
        "incremental_score": SCORED,
        "incremental_score_hashed": f"select md5(cast(doc_id as varchar)) as doc_id, lang, positive from ({SCORED}) s",
        "stage_counts": staged_counts(None, 8),
        "stage_clear": staged_counts("labeled", 3) + " union all " + staged_counts("derived", 1),
        "stage_guards": """select t.*, (select count(*) from documents) as raw_rows, cast(0 as bigint) as preview_columns from (values
  ('stage', 'raw', true), ('stage', 'sampled', true), ('stage', 'labeled', false), ('stage', 'reviewed', false), ('stage', 'train', false), ('stage', 'val', false),
  ('stage', 'test', false), ('stage', 'predictions', false), ('column', 'doc_id', true), ('column', 'lang', true), ('column', 'text', false)) t (kind, name, present)""",
        "split_ratios": " union all ".join(
            [
                f"""select '{train}/{val}/{test}' as ratios, split, count(*) as rows from ({floor_split("(select * from labels)", "quality", "doc_id", "doc_id", train, val, 42)}) t group by split"""
                for train, val, test in ((0.8, 0.1, 0.1), (0.5, 0.25, 0.25))
            ]
            + [f"select '{ratios}', 'refused', count(*) from labels" for ratios in ("0.8/0.1/0.2", "1.1/-0.1/0.0")]
        ),
        "run_record": f"""select 'first' as run, true as stamped, 'text' as text_column, 'quality' as label_column, cast(8 as bigint) as epochs, cast(8 as bigint) as tried,
  split, count(*) as support, count(*) filter (quality = 1) as tp, count(*) filter (quality = 0) as tn from {LEARNT} t group by split""",
        "stage_replace": """select cast(d.doc_id as varchar) as doc_id, lang, coalesce(cast(quality as varchar), '') as quality
from documents d left join labels l on d.doc_id = l.doc_id""",
        "stage_append": "select doc_id, lang, source, n_chars from documents",
        "stage_union": "select doc_id, lang, null::integer as quality, null::integer as toxic from documents union all select doc_id, null, quality, toxic from labels",
        "export_chunks": """select d.doc_id, md5(d.doc_id || '|' || coalesce(lang, '') || '|' || coalesce(cast(quality as varchar), '')) as cells_md5,
  sheet, min(d.doc_id) over (partition by sheet) as first_id
from (select *, (row_number() over (order by doc_id) - 1) // 100 + 1 as sheet from documents) d left join labels l on d.doc_id = l.doc_id""",
        "import_skips_known": f"select okey, coalesce(status, '') as status, true as dense, (select count(*) from orders) as rows from {ORDER_TEXTS} t",
        "csv_round_trip": "select conv_id, turn, md5(text) as text_md5 from conversations",
        "train_evaluate": ratios(f"select split, {METRICS.replace('predicted', 'quality')} from {LEARNT} t group by split", "split"),
        "train_score": """select doc_id, case when q = 1 then '正样本' else '负样本' end as label, q = 1 as positive, true as sure from (
  select d.doc_id, coalesce(quality, cast(n_chars > 1000 as integer)) as q from documents d left join labels l on d.doc_id = l.doc_id) t""",
        "score_with_function": """select doc_id, case when contains(text, 'tion') then '正样本' else '负样本' end as label,
  case when contains(text, 'tion') then 0.75::double else 0.25::double end as positive, 0.75::double as confidence from documents""",
        "reevaluate": f"""select split, count(*) as support, count(*) filter (quality = 1) as tp, count(*) filter (quality = 0) as tn,
  0 as fp, 0 as fn, 1.0::double as accuracy from {LEARNT} t group by split""",
        "file_hash": "select item_id, sha256(text || chr(10)) as file_hash, sha256(text || chr(10)) as in_pieces from benchmark",
        "import_lineage": f"""select row_number() over (order by status <> 'O', okey) as __record_id, case when status = 'O' then 1 else 2 end as file_no, 'txt' as suffix,
  'key,state,state_2,key_2' as headers, okey as cell_0, status as cell_1, priority as cell_2, price as cell_3 from {ORDER_TEXTS} t""",
        "dataset_stats": "select count(*) as row_count, cast(4 as bigint) as column_count, true as raw_data_ready from orders",
        "raw_preview": f"""select okey, status, priority, case when status = 'O' then '' else price end as price from (
  select *, row_number() over (order by status <> 'O', okey) as id from {ORDER_TEXTS} t) u where id between 51 and 100""",
        "schema_published": """select * from (values ('okey', 1, 'text', true), ('status', 2, 'text', true), ('priority', 3, 'text', true), ('price', 4, 'text', true))
  t (column_name, column_index, data_type_guess, stamped)""",
        "head_rows": f"select * from {ORDERS} t order by o_orderkey limit 25",
        "keyword_many": """select c_custkey, c_name from customer where exists (select 1 from range(1000) r(k)
  where contains(c_name, cast(1000 + 7 * k as varchar)) or contains(cast(cast(c_acctbal as decimal(18,2)) as varchar), cast(1000 + 7 * k as varchar)))""",
        "keyword_many_all": "select c_custkey, c_name from customer where c_custkey % 3 <> 0",
        "page_text_ids": """select l_orderkey || '/' || l_linenumber as item, l_quantity from lineitem order by 1 limit 200 offset 10500""",
        "page_hashed_ids": """select (cast('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 15) as bigint) - 576460752303423488) * 15 as hashed, o_orderkey
from orders order by 1 limit 200 offset 900""",
    }
