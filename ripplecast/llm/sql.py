"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from ripplecast.llm.secret_scan import BASE, RULES

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def either_case(pattern: str, letters: str) -> str:
    """letters of the pattern's keyword group in either case."""
    head, _, rest = pattern.partition(")")
    return "".join(f"[{c.upper()}{c}]" if c in letters else c for c in head) + ")" + rest


def secrets() -> str:
    parts = []
    for number, rule in enumerate(RULES):
        p = rule.pattern.decode()
        if rule.kind == "assign":
            p = either_case(p, LOWER)
        p = p.replace("'", "''")
        find = lambda g, p=p: f"regexp_extract_all(t, '(?s)(.*?)({p})', {g})"
        size = f"list_transform({find(2 + rule.group)}, lambda x: len(x))"
        parts.append(f"SELECT rid, {number} AS k, '{rule.kind}' AS kind, list_transform({find(1)}, lambda x: len(x)) AS gaps, list_transform({find(2)}, lambda x: len(x)) AS sizes, {size} AS own, {rule.least} AS least FROM d")
    count = lambda k: f"count(*) FILTER (kind='{k}') AS n_{k}"
    joined = lambda cond: f"coalesce(string_agg(kind||':'||s||':'||e, ',' ORDER BY s, k) FILTER ({cond}), '')"
    base = "kind IN (" + ",".join(f"'{b}'" for b in BASE) + ")"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text,'') AS t FROM documents),
    m AS ({' UNION ALL '.join(parts)}), x AS (SELECT *, unnest(range(1, len(gaps)+1)) AS j FROM m),
    spans AS (SELECT rid, k, kind, CAST(list_sum(gaps[1:j])+coalesce(list_sum(sizes[1:j-1]),0) AS BIGINT) AS s, CAST(list_sum(gaps[1:j])+list_sum(sizes[1:j]) AS BIGINT) AS e FROM x WHERE own[j]>=least)
    SELECT any_value(doc_id) AS doc_id, {', '.join(map(count, BASE))}, sha256({joined(base)}) AS base_sha256, {joined('kind IS NOT NULL')} AS spans FROM d LEFT JOIN spans USING (rid) GROUP BY rid"""


def leaks() -> str:
    words = lambda c: rf"regexp_extract_all(translate(coalesce({c},''),'{UPPER}','{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS w FROM documents),
    b AS (SELECT row_number() OVER () AS bid, CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark),
    bw AS (SELECT DISTINCT bid, item, least(len(w),10) AS n, array_to_string(w[i:i+least(len(w),10)-1],' ') AS key FROM (SELECT bid, item, w, unnest(range(1, greatest(len(w)-9,1)+1)) AS i FROM b WHERE len(w)>0)),
    dw AS (SELECT rid, n, i, array_to_string(w[i:i+n-1],' ') AS key FROM (SELECT rid, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w)>=n)),
    hit AS (SELECT rid, bid, item, i, n FROM dw JOIN bw USING (n, key)),
    pos AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(i, i+n)) AS p FROM hit) GROUP BY rid),
    its AS (SELECT rid, count(*) AS c, string_agg(item, ',' ORDER BY item) AS a FROM (SELECT DISTINCT rid, bid, item FROM hit) GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(pos.c,0) AS n_hit, coalesce(its.c,0) AS n_items, sha256(coalesce(a,'')) AS items_sha256, coalesce(pos.c,0)>0 AS contaminated FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""


def mixing() -> str:
    return rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''),'{WORD}')) AS size, CAST('0x'||substr(md5('mix-1|'||coalesce(CAST(doc_id AS VARCHAR),'')||'|'||md5(coalesce(text,''))),1,15) AS BIGINT) AS o FROM documents),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
    s1 AS (SELECT *, [5,2,1][(row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1] AS w, 1.5::DOUBLE*sum(n) OVER () AS v FROM s0),
    s2 AS (SELECT *, coalesce(sum(2*n) OVER x,0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER x,0) AS ws FROM s1 WINDOW x AS (ORDER BY 2*n::DOUBLE/w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s3 AS (SELECT *, (v-caps)*w/ws > 2*n AS full_ FROM s2),
    s4 AS (SELECT source, n, CASE WHEN full_ THEN 2.0::DOUBLE*n ELSE (v-sum(CASE WHEN full_ THEN 2*n ELSE 0 END) OVER ())*w/sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target FROM s3),
    p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM d)
    SELECT doc_id, p.size, n AS source_size, target, CAST(greatest(0,least(size,floor(target)-b))+greatest(0,least(size,floor(target)-n-b)) AS BIGINT) AS taken FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source"""


def chat(probe: str) -> str:
    text = probe.replace("'", "''")
    marks = lambda c: rf"(len({c})+len(regexp_extract_all({c},'[\\<>]')))"
    return rf"""WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{text}' UNION ALL SELECT -7, 1, 'assistant', '{text}'),
    f AS (SELECT *, len(regexp_extract_all(text,'{WORD}'))+4 AS tok, 16+{marks('role')}+{marks('text')} AS chars FROM t),
    g AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM f),
    h AS (SELECT *, b//512 AS win FROM g), k AS (SELECT *, max(b+tok) OVER (PARTITION BY conv_id, win) AS stop, max(win) OVER (PARTITION BY conv_id) AS last FROM h),
    c AS (SELECT conv_id, count(DISTINCT win)-1 AS more, max(CASE WHEN b=0 AND role='system' THEN chars ELSE 0 END) AS sys, sum(chars) AS own, sum(CASE WHEN win<last AND b>=stop-128 AND NOT (b=0 AND role='system') THEN chars ELSE 0 END) AS again FROM k GROUP BY conv_id),
    z AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10),'' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(string_agg(text,'' ORDER BY turn NULLS FIRST, text) FILTER (role='assistant'),'') AS loss FROM t GROUP BY conv_id)
    SELECT z.conv_id, n_turns, turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(own+again+more*sys AS BIGINT) AS formatted_chars FROM z JOIN c ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""
