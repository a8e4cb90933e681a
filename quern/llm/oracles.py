"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_CRLF = "chr(13) || chr(10)"


def _record(url: str, body: str) -> str:
    return (
        f"('WARC/1.1' || {_CRLF} || 'WARC-Type: response' || {_CRLF} || 'WARC-Target-URI: ' || {url} || {_CRLF} || "
        f"'Content-Length: ' || strlen({body}) || {_CRLF} || {_CRLF} || {body} || {_CRLF} || {_CRLF})"
    )


def _levels(source: str, name: str) -> str:
    out = [
        f"{name}0 AS (SELECT volume, \"offset\" // 65536 AS place, sha256(string_agg(concat_ws(' ', \"offset\", length, copies, digest), "
        f"chr(10) ORDER BY \"offset\")) AS hash FROM {source} GROUP BY ALL)"
    ]
    for i in range(4):
        out.append(
            f"{name}{i + 1} AS (SELECT volume, place // 16 AS place, sha256(string_agg(place || ' ' || hash, chr(10) ORDER BY place)) "
            f"AS hash FROM {name}{i} GROUP BY volume, place // 16)"
        )
    return ",\n".join(out)


FIXITY = f"""
WITH r AS (
  SELECT page_id AS record_id, coalesce(url, '') AS u, html, {_record("coalesce(url, '')", "coalesce(html, '')")} AS c FROM pages
), d AS (
  SELECT record_id, sha256(c) AS digest, strlen(c)::BIGINT AS length,
    CASE WHEN starts_with(md5(c), '01') THEN NULL
         WHEN starts_with(md5(c), '00') THEN sha256({_record("u", "coalesce('X' || substr(html, 2), '')")})
         ELSE sha256(c) END AS stored_digest
  FROM r
), e AS (
  SELECT *, count(*) AS copies, coalesce(record_id // 1024, -1) AS shelf FROM d GROUP BY ALL
), s AS (SELECT shelf, (count(*) + 4095) // 4096 AS parts FROM e GROUP BY shelf),
p AS (SELECT e.*, concat('0x', substr(digest, 1, 7))::BIGINT % parts AS part FROM e JOIN s USING (shelf)),
m AS (
  SELECT shelf || '-' || part AS volume,
    coalesce(sum(length * copies) OVER (PARTITION BY shelf, part ORDER BY record_id NULLS FIRST, digest, stored_digest NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
    length, copies, digest, stored_digest
  FROM p
), a AS (SELECT volume, "offset", length, copies, digest FROM m),
b AS (SELECT volume, "offset", length, copies, stored_digest AS digest FROM m WHERE stored_digest IS NOT NULL),
{_levels("a", "ta")},
{_levels("b", "tb")}
SELECT volume, "offset", coalesce(a.length, b.length) AS length,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS kind,
  a.digest AS digest, b.digest AS replica_digest, x.hash AS root, y.hash AS replica_root
FROM a FULL JOIN b USING (volume, "offset")
LEFT JOIN (SELECT volume, hash FROM ta4 WHERE place = 0) x USING (volume)
LEFT JOIN (SELECT volume, hash FROM tb4 WHERE place = 0) y USING (volume)
WHERE (a.length, a.copies, a.digest) IS DISTINCT FROM (b.length, b.copies, b.digest)
"""

URL_LISTS = r"""
WITH c AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url,
      '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)', 1)), '\.+$', ''), '') AS host,
    DATE '2024-01-01' + ((page_id * 37) % 365)::INT AS fetch_date
  FROM pages
), h AS (SELECT DISTINCT host AS key, string_split(host, '.') AS labels FROM c WHERE host IS NOT NULL),
up AS (
  SELECT key AS host, i - 1 AS level, CASE i WHEN 1 THEN key ELSE array_to_string(labels[i:], '.') END AS key
  FROM (SELECT key, labels, unnest(generate_series(1, CASE WHEN regexp_matches(key, '^(\[.*|[0-9]+(\.[0-9]+){3})$') THEN 1 ELSE greatest(len(labels) - 1, 1) END)) AS i FROM h)
), tops AS (SELECT DISTINCT arg_max(key, level) AS key FROM up GROUP BY host),
k AS (
  SELECT key, unnest([1, 2, 3]) AS place FROM h UNION ALL SELECT key, unnest([11, 12]) FROM tops
), n AS (
  SELECT key, place,
    DATE '2024-01-01' + (concat('0x', substr(md5(key || '#' || place), 1, 6))::BIGINT % 365)::INT AS day,
    ['block', 'allow', 'remove'][concat('0x', substr(md5(key || '#' || place), 7, 2))::BIGINT % 3 + 1] AS action
  FROM k
), o AS (SELECT key, day, arg_max(action, place) AS action FROM n GROUP BY key, day),
v AS (SELECT key, action, day AS since, coalesce(lead(day) OVER (PARTITION BY key ORDER BY day), DATE '9999-12-31') AS until FROM o),
hit AS (
  SELECT c.page_id, up.level, v.action, v.key, v.since
  FROM c JOIN up ON c.host = up.host JOIN v ON v.key = up.key AND v.action <> 'remove'
    AND v.since <= c.fetch_date AND c.fetch_date < v.until
  QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY up.level) = 1
)
SELECT c.page_id, c.host, c.fetch_date::VARCHAR AS fetch_date, hit.action AS action, hit.key AS matched, hit.since::VARCHAR AS since
FROM c LEFT JOIN hit USING (page_id)
"""


def _fill(children: str, parent: str, key: str) -> str:
    """Water filling of ``children`` (with weight, capacity, b) as a subquery with ``given``."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY capacity / weight, {key}"
    return f"""(
  SELECT * EXCLUDE (nth, first_nth, spare, rest, unit_spare, unit_rest),
    least(CASE WHEN first_nth IS NULL OR nth < first_nth THEN capacity ELSE unit_spare * weight // unit_rest END, capacity)::BIGINT AS given
  FROM (
    SELECT *, min(CASE WHEN open THEN nth END) OVER ({by}) AS first_nth,
      arg_min(CASE WHEN open THEN spare END, CASE WHEN open THEN nth END) OVER ({by}) AS unit_spare,
      arg_min(CASE WHEN open THEN rest END, CASE WHEN open THEN nth END) OVER ({by}) AS unit_rest
    FROM (
      SELECT *, spare * weight < capacity * rest AS open FROM (
        SELECT *, row_number() OVER ({order}) AS nth,
          greatest(b - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS spare,
          (sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
        FROM {children}))))"""


MIXING = rf"""
WITH d AS (
  SELECT doc_id, coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4), '(none)') AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens,
    coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS name
  FROM documents
), items AS (SELECT domain, lang, source, name, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
sums AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS capacity, 1::BIGINT AS weight
  FROM items GROUP BY ALL
), langs AS (
  SELECT domain, lang, sum(capacity)::BIGINT AS capacity,
    CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END::BIGINT AS weight
  FROM sums GROUP BY domain, lang
), tops AS (
  SELECT domain, sum(capacity)::BIGINT AS capacity,
    CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END::BIGINT AS weight,
    ((sum(sum(capacity)) OVER ()) // 2 * 4 // 5)::BIGINT AS b
  FROM langs GROUP BY domain
), f1 AS (SELECT domain, given FROM {_fill("tops", "", "domain")}),
l2 AS (SELECT langs.*, f1.given AS b FROM langs JOIN f1 USING (domain)),
f2 AS (SELECT domain, lang, given FROM {_fill("l2", "domain", "lang")}),
l3 AS (SELECT sums.*, f2.given AS b FROM sums JOIN f2 USING (domain, lang)),
plan AS (
  SELECT domain, lang, source, given AS leaf_budget,
    CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS full_epochs,
    CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest
  FROM {_fill("l3", "domain, lang", "source")}
), cut AS (
  SELECT domain, lang, source, max(CASE WHEN so_far <= rest THEN h END) AS cutoff
  FROM (
    SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h ROWS UNBOUNDED PRECEDING) AS so_far
    FROM (SELECT *, md5('23:' || full_epochs || ':' || name) AS h FROM items JOIN plan USING (domain, lang, source) WHERE rest > 0)
  ) GROUP BY ALL
), taken AS (
  SELECT doc_id, domain, lang, source, tokens, leaf_budget,
    (full_epochs + (md5('23:' || full_epochs || ':' || name) <= coalesce(cutoff, ''))::INT)::BIGINT AS copies
  FROM d JOIN plan USING (domain, lang, source) LEFT JOIN cut USING (domain, lang, source)
)
SELECT * FROM taken WHERE copies > 0
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, lines, generate_subscripts(lines, 1) AS i FROM t),
k AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {_BLANK}), {_UPPER}, {_SMALL}) AS key FROM e),
held AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, i, line, first_doc IS NOT NULL AND k.doc_id <> first_doc AS gone FROM k LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

COLLOCATION = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split(translate(coalesce(text, ''), {_UPPER} || '.,;:!?' || chr(11) || chr(12) || chr(13), {_SMALL} || repeat(chr(10), 9)), chr(10))) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM p
), s AS (
  SELECT lang, w, len(w) AS size, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0
), g AS (
  SELECT lang, w[i:i + k - 1] AS phrase FROM (SELECT *, unnest(generate_series(1, least(5, size - i + 1))) AS k FROM s)
), f AS (SELECT lang, phrase, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
t AS (SELECT lang, sum(size)::BIGINT AS n FROM (SELECT lang, len(w) AS size FROM w) GROUP BY lang),
c AS (SELECT lang, phrase, a, unnest(generate_series(1, len(phrase) - 1)) AS k FROM f WHERE len(phrase) > 1),
o AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1:k] JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1:] JOIN t ON t.lang = c.lang
), low AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, phrase[2:] AS phrase, a FROM f WHERE len(phrase) > 2 UNION ALL SELECT lang, phrase[1:len(phrase) - 1], a FROM f WHERE len(phrase) > 2)
  GROUP BY lang, phrase
)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, array_to_string(low.phrase, ' ')) AS rank,
  array_to_string(low.phrase, ' ') AS phrase, a, l, r, n, score
FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.phrase = low.phrase
WHERE longer IS NULL OR longer < a
QUALIFY rank <= 2000
"""

#: Of a byte string's decimal digits and sign: each character, then eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''),
    lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT *, {_CRC.format(text="conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS base
  FROM (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id)
), hs AS (SELECT c.conv_id, c.h, c.base, c.own, least(c.h, coalesce(b.own, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT hs.conv_id, place, role, text FROM hs JOIN t ON t.conv_id = hs.base AND place <= head
  UNION ALL
  SELECT hs.conv_id, place - h + head, role, text FROM hs JOIN t USING (conv_id) WHERE place > h
), n AS (SELECT conv_id, (SELECT count(*) FROM r WHERE r.conv_id = hs.conv_id) AS turns FROM hs),
p AS (
  SELECT conv_id, place AS depth, strlen(text) AS bytes,
    sha256(list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY place)::JSON::VARCHAR) AS key
  FROM r
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM hs
), q AS (SELECT p.*, turns, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM p JOIN n USING (conv_id)),
nodes AS (
  SELECT depth, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, bool_and(turns = depth) AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM q GROUP BY depth, key
), up AS (
  SELECT q.key, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * nodes.bytes)::BIGINT AS saved_tokens
  FROM nodes JOIN q ON q.conv_id = nodes.conv_id AND q.depth <= nodes.depth GROUP BY q.key
), kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes y ON y.key = x.parent JOIN up ON up.key = x.key LEFT JOIN kids ON kids.key = x.key
"""

SQL = {"op2_fixity": FIXITY, "op6_url_lists": URL_LISTS, "op10_mixing": MIXING, "op11_line_dedup": LINE_DEDUP, "op12_collocation": COLLOCATION, "op13_prefix_trie": PREFIX_TRIE}
