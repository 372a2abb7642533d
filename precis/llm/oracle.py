"""DuckDB statements for the ``opN_*`` queries that SQL can express on whole
tables.  The others are tested against brute force in tests/llm."""

from __future__ import annotations

from precis.llm import divergence, mixing, secrets

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS9 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secret_scan() -> str:
    """The same patterns; every window's entropy from its own counts."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    patterns = {"assign": rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+",
                "hex": "[0-9a-f]+"}
    least = {"assign": 8, "access": 16, "hex": 32}
    parts = []
    for k, (kind, p) in enumerate(patterns.items()):
        group = 2 if kind == "assign" else 0
        parts.append(f"""
        SELECT doc_id, {k} AS k, unnest(h) AS h, unnest(c) AS c, generate_subscripts(h, 1) AS i, g, h AS hs FROM (
          SELECT doc_id, regexp_extract_all(t, {_quoted(p)}, 0) AS h, regexp_extract_all(t, {_quoted(p)}, {group}) AS c,
                 string_split_regex(t, {_quoted(p)}) AS g FROM d WHERE regexp_matches(t, {_quoted(p)}))
        """)
    place = ("cast(list_sum(list_transform(g[1:i], lambda x: length(x))) "
             "+ coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0) AS BIGINT)")
    wanted = " OR ".join(f"(k = {k} AND length(c) >= {least[kind]})" for k, kind in enumerate(patterns))
    added, before = [], "base"
    for n, (_, p, window, bits) in enumerate(secrets.ENTROPY):
        added.append(f"""
        e{n} AS (
          SELECT doc_id, s, 3 AS k, s + length(h) AS e FROM (
            SELECT doc_id, h, g[i] AS gap, {place} AS s FROM (
              SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS i, g, h AS hs FROM (
                SELECT doc_id, regexp_extract_all(t, {_quoted(p)}, 0) AS h, string_split_regex(t, {_quoted(p)}) AS g
                FROM d WHERE regexp_matches(t, {_quoted(p)})))) x
          WHERE NOT regexp_matches(h, {_quoted(secrets.ALLOWED)}) AND NOT regexp_matches(gap, {_quoted(secrets.ALLOWED_BEFORE)})
            AND list_max(list_transform(range(0, length(h) - {window} + 1), lambda j: list_aggregate(
                  string_split(substr(h, j + 1, {window}), ''), 'entropy'))) >= {bits}
            AND NOT EXISTS (SELECT 1 FROM {before} b WHERE b.doc_id = x.doc_id AND b.s < x.s + length(x.h) AND b.e > x.s)),
        s{n} AS (SELECT * FROM {before} UNION ALL SELECT * FROM e{n})""")
        before = f"s{n}"
    label = f"(['assign', 'access', 'hex', 'entropy'])[k + 1] || ':' || s || ':' || e"
    listed = f"string_agg({label}, ',' ORDER BY s, k)"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS (SELECT doc_id, s, k, s + length(h) AS e FROM (
      SELECT doc_id, k, h, c, {place} AS s FROM ({' UNION ALL '.join(parts)})) WHERE {wanted}),
    {', '.join(added)},
    b AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
                 {listed} AS l FROM base GROUP BY doc_id),
    a AS (SELECT doc_id, count(*) FILTER (k = 3) AS n3, {listed} AS l FROM {before} GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
           coalesce(n3, 0) AS n_entropy, sha256(coalesce(b.l, '')) AS base_sha256, coalesce(a.l, '') AS spans
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
    """


def _mixing(fraction: float = 0.5, epochs: int = 2, seed: int = 1) -> str:
    """The same whole-number shares, level by level; running sums over whole leaves."""
    def weight(level: str) -> str:
        cases = "".join(f" WHEN {_quoted(k)} THEN {v}" for k, v in mixing.WEIGHTS.get(level, {}).items())
        return f"CASE {level}{cases} ELSE 1 END" if cases else "1"

    steps, parent, above = [], [], "l0"
    for n, level in enumerate(mixing.LEVELS, 1):
        path = [*parent, level]
        on = " AND ".join(f"c.{c} IS NOT DISTINCT FROM p.{c}" for c in parent) or "true"
        part = "PARTITION BY " + ", ".join(parent) if parent else ""
        ranked = f"OVER ({part} ORDER BY supply / w, {level} NULLS FIRST"
        steps.append(f"""
        l{n}a AS (SELECT c.*, p.budget AS b, {weight(level).replace(level, 'c.' + level, 1)} AS w FROM (
            SELECT {', '.join(path)}, sum(supply)::HUGEINT AS supply, sum(tokens)::HUGEINT AS tokens FROM leaves GROUP BY ALL) c
          JOIN {above} p ON {on} WHERE supply > 0),
        l{n}b AS (SELECT *, coalesce(sum(supply) {ranked} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
            (sum(w) {ranked} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS wl FROM l{n}a),
        l{n}c AS (SELECT *, supply * wl <= (b - before) * w AS is_full FROM l{n}b),
        l{n} AS (SELECT {', '.join(path)}, tokens, CASE WHEN is_full THEN supply ELSE
            ((b - coalesce(sum(supply) FILTER (is_full) OVER ({part}), 0)::HUGEINT) * w)
            // greatest(coalesce(sum(w) FILTER (NOT is_full) OVER ({part}), 0), 1)::HUGEINT END AS budget FROM l{n}c)""")
        parent, above = path, f"l{n}"
    same = " AND ".join(f"f.{c} IS NOT DISTINCT FROM g.{c}" for c in mixing.LEVELS)
    leaf = ", ".join(mixing.LEVELS)
    return f"""
    WITH f AS (SELECT doc_id, lang, source, md5(coalesce(text, '')) AS th,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::HUGEINT AS n_tokens,
        CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN 'other'
             WHEN regexp_extract(source, '([0-9]+)$', 1)::BIGINT < 10 THEN 'web' ELSE 'books' END AS domain FROM documents),
    leaves AS (SELECT {leaf}, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {epochs} AS supply FROM f GROUP BY ALL),
    l0 AS (SELECT least(sum(supply), floor(sum(tokens) * {fraction}))::HUGEINT AS budget FROM leaves),
    {', '.join(steps)},
    g AS (SELECT *, budget // greatest(tokens, 1) AS whole, budget % greatest(tokens, 1) AS rest FROM l3),
    k AS (SELECT f.*, g.budget, g.whole, g.rest, md5(concat_ws(':', '{seed}', g.whole + 1, f.doc_id, f.th)) AS key
          FROM f JOIN g ON {same}),
    r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY key) AS so_far FROM k),
    e AS (SELECT {leaf}, min(key) AS end_key FROM r WHERE so_far > rest GROUP BY ALL),
    t AS (SELECT r.*, whole + CASE WHEN rest > 0 AND (end_key IS NULL OR key < end_key) THEN 1 ELSE 0 END AS times
          FROM r LEFT JOIN e ON {' AND '.join(f'r.{c} IS NOT DISTINCT FROM e.{c}' for c in mixing.LEVELS)})
    SELECT doc_id, {leaf}, unnest(range(1, times::BIGINT + 1))::INTEGER AS epoch, n_tokens::BIGINT AS n_tokens,
           budget::BIGINT AS budget FROM t WHERE times > 0
    """


CHAT = """
WITH c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS l,
                  count(*) AS n FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:unnest(range(1, n))] AS l FROM c)
SELECT min(conv_id) AS conv_id, 0::BIGINT AS part, n AS n_turns, count(*) AS n_same,
       array_to_string(list_transform(l, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS text
FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY l, n
"""


def _divergence() -> str:
    def lists(c: str) -> str:
        return "CASE lang " + " ".join(
            f"WHEN {_quoted(k)} THEN {['%s' % w for w in words]}" for k, words in divergence.COMMON_WORDS.items()) + " END"

    bins = "list_transform({0}, lambda x: x::DOUBLE / {1})"
    js = ("sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: "
          "CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END "
          "+ CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END)) / 2, 0))")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
        FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
    again AS (SELECT doc_id, k FROM g GROUP BY ALL HAVING count(*) > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN again USING (doc_id, k)) GROUP BY doc_id),
    m0 AS (SELECT d.doc_id, lang, t, w, length(t) AS nc, len(w) AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS up,
        len(regexp_extract_all(t, '[0-9]')) AS dg, len(regexp_extract_all(t, '[!"''(),.:;?-]')) AS pt,
        list_transform({lists('lang')}, lambda c: len(list_filter(w, lambda x: x = c))) AS cw
        FROM d LEFT JOIN rep USING (doc_id)),
    m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        [up, dg, pt, n_symbols, nc - word_chars, nc - (up + dg + pt + n_symbols + nc - word_chars)] AS classes,
        CASE WHEN cw IS NOT NULL THEN list_append(cw, n_words - list_sum(cw)::BIGINT) END AS commons FROM m0),
    rc AS (SELECT lang, list(s ORDER BY i) AS s FROM (SELECT lang, i, sum(classes[i]) AS s FROM m, range(1, 7) AS u(i)
        WHERE NOT base_failed GROUP BY ALL) GROUP BY lang),
    rw AS (SELECT lang, list(s ORDER BY i) AS s FROM (SELECT lang, i, sum(commons[i]) AS s FROM m, range(1, 26) AS u(i)
        WHERE NOT base_failed AND commons IS NOT NULL GROUP BY ALL) GROUP BY lang),
    v AS (SELECT m.*,
        CASE WHEN nc >= {divergence.CLASS_MIN_CHARS} AND rc.s IS NOT NULL THEN {js.format(
            p=bins.format('classes', 'nc'), q=bins.format('rc.s', 'greatest(list_sum(rc.s), 1)'))} END AS cd,
        CASE WHEN n_words >= {divergence.WORD_MIN_WORDS} AND commons IS NOT NULL AND rw.s IS NOT NULL THEN {js.format(
            p=bins.format('commons', 'n_words'), q=bins.format('rw.s', 'greatest(list_sum(rw.s), 1)'))} END AS wd
        FROM m LEFT JOIN rc USING (lang) LEFT JOIN rw USING (lang))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND coalesce(round(cd, 9) <= {divergence.CLASS_LIMIT}, true)
        AND coalesce(round(wd, 9) <= {divergence.WORD_LIMIT}, true) AS kept,
        round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM v
    """


WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: (['0000', '0001', '0010', '0011', '0100', '0101',
        '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'])[instr('0123456789abcdef', c)]), '') AS bits
      FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(0, 5), lambda j: cast(substr(bits, i * 5 + j + 1, 1) AS INTEGER) * (1 << (4 - j))))::INTEGER,
        1)), '') AS digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM m
"""

DECONTAMINATION = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS9}') AS ws FROM documents),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (
    SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM (
      SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS9}') AS ws FROM benchmark) WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (
    SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS s FROM w, lens WHERE len(ws) >= n)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS c, string_agg(i, ',' ORDER BY i) AS l FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(places.c, 0) AS n_hit, coalesce(items.c, 0) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(places.c, 0) > 0 AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS9}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[s:s + 4], ' ') END AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, '|' ORDER BY k)) AS h FROM g GROUP BY 1),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h, n) AS class_id FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * i >= 4 * (x.n + y.n - i)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(l.c, 0) AS n_links,
       least(w.doc_id, coalesce(q.m, w.doc_id)) AS group_id, coalesce(c.n, 0) AS n_shingles
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS c FROM e GROUP BY 1) l USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) q USING (doc_id)
"""

SECRET_SCAN, MIXING, DIVERGENCE = _secret_scan(), _mixing(), _divergence()


def _line_dedup() -> str:
    """Keys and their documents by grouping."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
    k AS (SELECT *, translate(trim(line, {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    held AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.*, held.last IS NOT NULL AND k.doc_id IS DISTINCT FROM held.last AS gone FROM k LEFT JOIN held USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY r
    """


def _filter_audit() -> str:
    """Every order by direct counting over the masks of each part, written as letters."""
    words = f"list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda w: w <> '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {words} AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    b AS (SELECT doc_id, part,
          CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END ||
          CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END ||
          CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END ||
          CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
          CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w),
    marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, fails, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
          FROM b LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier
          FROM o, (SELECT unnest(range(1, 6)) AS step)),
    j AS (SELECT part, filter_order, step, x, docs, good, toxic, contains(fails, x) AS hit, fails = x AS alone,
                 translate(fails, earlier, '') = fails AS here FROM s, m),
    r AS (SELECT part, filter_order, step, x, coalesce(sum(docs) FILTER (here AND NOT hit), 0) AS kept,
          coalesce(sum(docs) FILTER (here AND hit), 0) AS removed, coalesce(sum(docs) FILTER (hit AND NOT here), 0) AS redundant,
          coalesce(sum(docs) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (here AND hit), 0) AS good_lost,
          coalesce(sum(toxic) FILTER (here AND hit), 0) AS toxic_lost FROM j GROUP BY part, filter_order, step, x)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
           unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM r
    """


LINE_DEDUP = _line_dedup()
FILTER_AUDIT = _filter_audit()


def _repair() -> str:
    """The edits by a recursive walk over the turns: for each state of the
    target (nothing put out, s, u, a) the least cost and edits as one string,
    cost first, so that strings compare as both.  crc32 is its own table."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    far = "'500000000'"
    pay = lambda s, cost, edit: f"(lpad((substr({s}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({s}, 10) || '{edit}')"
    put_in = (f"n, s, least(u, {pay('n', 3, 'I')}, {pay('s', 3, 'I')}, {pay('a', 3, 'I')}) AS u, "
              f"least(a, {pay('u', 3, 'I')}, {pay('n', 6, 'II')}, {pay('s', 6, 'II')}) AS a")
    more = "CASE WHEN open THEN 3 ELSE 0 END"

    def own(to: str, sources: str) -> str:
        moves = [pay(to, 4, "D")]
        for x in sources:
            moves.append(f"CASE WHEN NOT must_go AND initial = '{to}' THEN {pay(x, more, 'K')} ELSE {far} END")
            if to != "s":
                moves.append(f"CASE WHEN NOT must_go THEN {pay(x, f'3 + {more}', 'R')} ELSE {far} END")
        return f"least({', '.join(moves)}) AS {to}"

    step = ", ".join([f"{pay('n', 4, 'D')} AS n", own("s", "n"), own("u", "nsa"), own("a", "u")])
    name = lambda m: f"CASE WHEN ({m} - hs) % 2 = 0 THEN 'user:' ELSE 'assistant:' END"
    return f"""
    WITH RECURSIVE poly(i, c, n) AS (SELECT i, i::UBIGINT, 0 FROM range(256) r(i) UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, n + 1 FROM poly WHERE n < 8),
    tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM poly WHERE n = 8),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(key) + 1),
        lambda i: ord(substr(key, i::INT, 1))::UBIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::INT + 1])),
        4294967295::UBIGINT) % 20 AS kind FROM keyed, tab),
    hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM hurt),
    judged AS (SELECT *, rtrim(text, {space}) AS t, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before, substr(role, 1, 1) AS initial FROM placed),
    f AS MATERIALIZED (SELECT conv_id, turn, pos, role, text, initial, t = '' AS blank, t <> '' AND nth > 1 AS dup,
        t <> '' AND nth = 1 AND substr(t, -1) NOT IN ('.', '!', '?') AS open, t = '' OR nth > 1 AS must_go,
        before IS NOT NULL AND (before || initial) NOT IN ('su', 'ua', 'au') AS wrong FROM judged),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (dup) AS duplicate, count(*) FILTER (open) AS truncated, count(*) FILTER (wrong) AS illegal,
        count(*) AS total FROM f GROUP BY conv_id),
    walk AS (SELECT conv_id, 0::BIGINT AS pos, '000000000' AS n, {far} AS s, {far} AS u, {far} AS a FROM counts UNION ALL
        SELECT conv_id, pos, {step} FROM (SELECT w.conv_id, f.pos, open, must_go, initial, {put_in} FROM walk w
            JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1)),
    ends AS (SELECT w.conv_id, least(n, a, {pay('u', 3, 'I')}, {pay('s', 6, 'II')}) AS best FROM walk w
        JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.total = w.pos),
    audits AS (SELECT conv_id, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit,
        regexp_extract_all(substr(best, 10), 'I*[KRD]') AS toks FROM ends),
    outs AS (SELECT f.conv_id, pos, role, text, initial, toks[pos] AS tok,
        length(replace(array_to_string(toks[1:pos - 1], ''), 'D', '')) AS m FROM f JOIN audits a ON a.conv_id IS NOT DISTINCT FROM f.conv_id),
    led AS (SELECT conv_id, max((tok LIKE '%K' AND initial = 's')::INT) AS hs FROM outs GROUP BY conv_id),
    lines AS (SELECT o.conv_id, pos, list_concat(list_transform(range(m, m + length(tok) - 1), lambda j: {name('j')}),
        CASE tok[-1] WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [{name('(m + length(tok) - 1)')} || text] ELSE [] END) AS said
        FROM outs o JOIN led l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
      UNION ALL SELECT a.conv_id, 9223372036854775807, list_transform(range(length(replace(array_to_string(toks, ''), 'D', '')),
        length(replace(audit, 'D', ''))), lambda j: {name('j')}) FROM audits a JOIN led l ON l.conv_id IS NOT DISTINCT FROM a.conv_id),
    repaired AS (SELECT conv_id, string_agg(array_to_string(said, chr(10)), chr(10) ORDER BY pos) FILTER (len(said) > 0) AS body
        FROM lines GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
        coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
    """


REPAIR = _repair()
