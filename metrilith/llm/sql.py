"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i+least(10,len(w))-1],' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w)-least(10,len(w))+2)) AS i FROM bw WHERE len(w)>0)),
ms AS (SELECT DISTINCT m FROM p),
dg AS (SELECT doc_id, m, i, array_to_string(w[i:i+m-1],' ') AS g
       FROM (SELECT doc_id, m, w, unnest(range(1, len(w)-m+2)) AS i FROM dw, ms WHERE len(w)>=m)),
h AS (SELECT doc_id, i, m, item_id FROM dg JOIN p USING (m, g)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+m)) AS k FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
      sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)),',')) AS items_sha256 FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items,
coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _kind(name: str, pattern: str, good: str) -> str:
    """Matches of a pattern with their places, from the lengths of what stands before them."""
    return f"""{name} AS (SELECT doc_id, list_filter(list_transform(range(1, len(m)+1), lambda i: {{'a':
 list_sum(list_transform(g[1:i], lambda z: length(z)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))),0)::BIGINT, 's': m[i]}}), lambda x: {good}) AS v
 FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d))"""


_DIGITS = "regexp_replace(x.s,'[^0-9]','','g')"
_TWICE = f"2*substr({_DIGITS},i,1)::INT"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS})+1), lambda i: CASE WHEN (length({_DIGITS})-i)%2=1 THEN CASE WHEN {_TWICE}>9 THEN {_TWICE}-9 ELSE {_TWICE} END ELSE substr({_DIGITS},i,1)::INT END))%10=0"
_KINDS = [
    _kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x.s,'.'), lambda q: ltrim(q,'0')='' OR (length(ltrim(q,'0'))<=3 AND ltrim(q,'0')::BIGINT<=255)))=4"),
    _kind("card", r"[0-9](?:[ -]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END"),
    _kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]
_ALL = ", ".join(f"list_transform({c}, lambda x: {{'a': x.a, 'k': {k}, 'b': x.a+length(x.s)}})" for k, c in enumerate("eicp"))

PII_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents), {", ".join(_KINDS)},
a AS (SELECT doc_id, email.v AS e, ip.v AS i, card.v AS c, phone.v AS p
      FROM email JOIN ip USING (doc_id) JOIN card USING (doc_id) JOIN phone USING (doc_id))
SELECT doc_id, len(e)::BIGINT AS n_email, len(i)::BIGINT AS n_ip, len(c)::BIGINT AS n_card, len(p)::BIGINT AS n_phone,
sha256(array_to_string(list_transform(list_sort(list_concat({_ALL})), lambda x: ['email','ip','card','phone'][x.k+1]||':'||x.a||':'||x.b),',')) AS base_sha256 FROM a"""

FILTER_AUDIT = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang,'') AS part, coalesce(text,'') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
q AS (SELECT doc_id, max(CASE WHEN quality=1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic=1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, (len(w)<200)::INT AS a, (100*len(list_distinct(w))<50*len(w))::INT AS b,
 (100*length(regexp_replace(t,'[^A-Z]','','g'))>3*length(t))::INT AS c, regexp_matches(t,'[#$%&*|]')::INT AS d,
 coalesce(doc_id>first_id,false)::INT AS e, coalesce(good,0) AS good, coalesce(toxic,0) AS toxic FROM w LEFT JOIN q USING (doc_id)),
m AS (SELECT part, a+2*b+4*c+8*d+16*e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
orders AS (SELECT '' AS o UNION ALL SELECT o||x FROM orders, (SELECT unnest(['A','B','C','D','E']) AS x) WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, s::INT AS step, 1<<(ascii(substr(o,s,1))-65) AS f,
 coalesce(list_sum(list_transform(range(1,s), lambda j: 1<<(ascii(substr(o,j,1))-65))),0)::BIGINT AS earlier
 FROM orders, (SELECT unnest(range(1,6)) AS s) WHERE length(o)=5),
r AS (SELECT part, filter_order, step, f,
 sum(CASE WHEN fails & (earlier | f) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
 sum(CASE WHEN fails & earlier = 0 AND fails & f <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN fails & earlier <> 0 AND fails & f <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
 sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN fails & earlier = 0 AND fails & f <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
 sum(CASE WHEN fails & earlier = 0 AND fails & f <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
 FROM m, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r"""

# CRC-32 byte by byte, by a table that its polynomial gives.
SPELLING = r"""
WITH RECURSIVE crc(i, k, v) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
 UNION ALL SELECT i, k+1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM crc WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text,''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR,'')||':'||run)) AS x FROM l),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x'||substr(x, i, 2))::BIGINT)),
 lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255)+1]))) AS h FROM b, tab),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run))||substr(run, h % length(run)+2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM w a JOIN w b ON length(b.word) BETWEEN length(a.word)-1 AND length(a.word)+1 AND a.word <> b.word
 AND (a.word[1:length(a.word)//2] = b.word[1:length(a.word)//2] OR right(a.word, length(a.word)//2-1) = right(b.word, length(a.word)//2-1))
 WHERE len(a.word) > 0 AND
 CASE WHEN length(a.word) = length(b.word) THEN len(list_filter(range(1, length(a.word)+1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1
 WHEN length(a.word) < length(b.word) THEN len(list_filter(range(1, length(b.word)+1), lambda i: substr(b.word, 1, i-1)||substr(b.word, i+1) = a.word)) > 0
 ELSE len(list_filter(range(1, length(a.word)+1), lambda i: substr(a.word, 1, i-1)||substr(a.word, i+1) = b.word)) > 0 END),
f AS (SELECT word, n, count(*) AS n_near, max(near_n) AS form_n, arg_min(near, (-near_n, near)) AS form FROM p GROUP BY 1, 2),
g AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5*w.n THEN form END AS form, CASE WHEN form_n >= 5*w.n THEN form_n END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
t AS (SELECT word, word AS root FROM g UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.word = t.root WHERE g.form IS NOT NULL)
SELECT g.word, g.n, g.n_near, g.form, g.form_n, t.root FROM g JOIN t ON t.word = g.word JOIN g z ON z.word = t.root WHERE z.form IS NULL"""

_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_EITHER})["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = rf"""^(?:{_EITHER})["'']? *[:=] *["'']?"""
_SECRETS = [
    _kind("assign", _ASSIGN, f"length(regexp_replace(x.s, '{_VALUE}', '')) >= 6"),
    _kind("access", "AKIA[A-Z0-9]+", "length(x.s) >= 20"),
    _kind("hexes", "[0-9a-f]{24,}", "true"),
]
_EACH = ", ".join(f"list_transform({c}, lambda x: {{'a': x.a, 'k': {k}, 'b': x.a+length(x.s)}})" for k, c in enumerate("sch"))

SECRET_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS doc_row, doc_id AS id, coalesce(text,'') AS t FROM documents), {", ".join(_SECRETS).replace("doc_id", "doc_row")},
a AS (SELECT id, assign.v AS s, access.v AS c, hexes.v AS h
      FROM d JOIN assign USING (doc_row) JOIN access USING (doc_row) JOIN hexes USING (doc_row))
SELECT id AS doc_id, len(s)::BIGINT AS n_assign, len(c)::BIGINT AS n_access, len(h)::BIGINT AS n_hex,
sha256(array_to_string(list_transform(list_sort(list_concat({_EACH})), lambda x: ['assign','access','hex'][x.k+1]||':'||x.a||':'||x.b),',')) AS base_sha256 FROM a"""
