"""DuckDB SQL for the queries of this subpackage that SQL can express, over the whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_WORDS = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2 = f"""with d as (select doc_id, regexp_extract_all({_lower('text')}, {_ITEM_WORDS}) w from documents),
b as (select item_id, regexp_extract_all({_lower('text')}, {_ITEM_WORDS}) w from benchmark),
win as (select item_id, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') k, least(len(w), 10) n from (select *, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from b where len(w) > 0)),
at_ as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') k from (select *, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from win) where len(w) >= n)),
hit as (select distinct doc_id, i, at_.n, item_id from at_ join win using (k)),
spots as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
items as (select doc_id, count(*) n_items, sha256(string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar))) s from (select distinct doc_id, item_id from hit) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join spots using (doc_id) left join items using (doc_id)"""

#: The rules of the secret scan as this dialect has them (repeats of more than 1000 in parts): pattern, group that is measured, least length, and a string that any match holds.
_SECRETS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ""),
    "access": (r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    "hex": (r"[0-9a-f]+", 0, 16, ""),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 40, "eyJ"),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----)?", 0, 20, "-----BEGIN "),
}


def _secrets() -> str:
    found = []
    for k, (kind, (pattern, group, least, part)) in enumerate(_SECRETS.items()):
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(
            f"select r, {k} k, '{kind}' kind, regexp_split_to_array(t, {p}) p, regexp_extract_all(t, {p}) f, regexp_extract_all(t, {p}, {group}) v, {least} least from d where contains(t, '{part}') and regexp_matches(t, {p})"
        )
    return f"""with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
h as ({' union all '.join(found)}),
m as (select r, k, kind, length(f[i]) n, length(v[i]) >= least ok, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) s from (select *, unnest(range(1, len(f) + 1)) i from h)),
a as (select r, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex, string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, k) filter (k < 3) base, string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, k) spans from (select * replace (cast(s as bigint) as s) from m where ok) group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (r)"""


OP3 = _secrets()

#: Sources at their limit come first by size over weight, so the level is that of the first place whose own source is not above it.
OP4 = f"""with d as (select row_number() over () r, doc_id, coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) draw, source, cast(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) as bigint) size from documents),
s as (select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint)] w from (select source, cast(sum(size) as bigint) z from d group by 1)),
o as (select *, row_number() over by_ratio i, cast(sum(z) over by_ratio as bigint) - z full_, cast(sum(w) over () - sum(w) over by_ratio + w as bigint) free, cast(sum(z) over () as bigint) total from s window by_ratio as (order by z / w, source nulls last rows between unbounded preceding and current row)),
l as (select *, (1.5e0 * total - 2 * full_) / free level from o),
p as (select source, z, least(w * (select arg_min(level, i) from l where w * level <= 2 * z), 2e0 * z) target from s),
q as (select *, case when z > 0 then target / z else 0e0 end rate from p),
x as (select r, doc_id, size, q.*, seed, cast('0x' || substr(md5(seed || ':' || draw), 1, 13) as bigint) / 4503599627370496e0 < rate - floor(rate) more from d join q on d.source is not distinct from q.source, (select unnest(range(16)) seed)),
b as (select source, arg_min(seed, (off, seed)) seed from (select source, seed, abs(any_value(floor(rate) * z) + sum(case when more then size else 0 end) - any_value(target)) off from x group by 1, 2) group by 1)
select doc_id, size, z source_size, target, cast(size * (floor(rate) + more::int) as bigint) taken from x join b on x.source is not distinct from b.source and x.seed = b.seed"""

OP5 = f"""with recursive d as (select doc_id, regexp_extract_all({_lower('text')}, {_WORDS}) w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 1), ' ') k from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
o as (select x.doc_id a, y.doc_id b, count(*) o from s x join s y on x.k = y.k and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where 100 * o >= 80 * (p.n + q.n - o)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, least(a, min(b)) c from r group by 1)
select d.doc_id, coalesce(n, 0) n_shingles, coalesce(c, d.doc_id) component_id, coalesce(c, d.doc_id) = d.doc_id kept from d left join n using (doc_id) left join c on c.a = d.doc_id"""

OP6 = """with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
g as (select payload_digest, max(page_id) m from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> m then 'revisit' else 'response' end record_type, case when payload_bytes >= 1000 and page_id <> m then m end refers_to
from p left join g using (payload_digest)"""

OP8 = rf"""with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t, cast('0x' || substr(md5(coalesce(text, '')), 1, 15) as bigint) c, regexp_extract_all(coalesce(text, ''), {_WORDS}) w from documents),
g as (select r, i, list_slice(w, i, i + 2) g from (select r, w, unnest(range(1, len(w) - 1)) i from d where len(w) > 2)),
rep as (select r, count(distinct p) n from (select r, unnest(range(i, i + 3)) p from g join (select r, g from g group by 1, 2 having count(*) > 1) using (r, g)) group by 1),
l as (select r, doc_id, source, c, line, trim(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) k from (select r, doc_id, source, c, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, {_WORDS})),
dup as (select r, count(*) - count(distinct line) n from l group by 1),
h as (select source, count(distinct c) n from d group by 1),
f as (select l.source, k, min(c) keeper from l join h on h.source is not distinct from l.source group by 1, 2, h.n having count(distinct c) > least(20e0, greatest(4e0, 0.08e0 * h.n))),
gone as (select r, sum(length(l.k) - length(replace(l.k, ' ', '')) + 1) n from l join f on f.source is not distinct from l.source and f.k = l.k where l.c <> f.keeper group by 1),
m as (select d.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
 coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, cast(coalesce(gone.n, 0) as bigint) n_removed_words from d left join rep using (r) left join dup using (r) left join gone using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * n_removed_words <= 50 * n_words kept from m"""

ORACLE_SQL = {"op2_decontaminate": OP2, "op3_secret_scan": OP3, "op4_mix_sources": OP4, "op5_near_duplicates": OP5, "op6_warc_revisits": OP6, "op8_quality_rules": OP8}

#: Vectors of unlike length have no product here; the given ones are all alike.
OP11 = """with v as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id a, b.id b, a.l = b.l same, cast(list_dot_product(a.v, b.v) as bigint) s from v a join v b on a.id <> b.id where a.id % 100 = 0),
p as (select a, b p, s ps from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select a anchor_id, p positive_id, cast(row_number() over w as int) rank, b negative_id, ps positive_score, s negative_score from p join s using (a) where not same and 80 * ps <= 100 * s and 100 * s <= 100 * ps
window w as (partition by a, p order by s desc, b) qualify row_number() over w <= 5"""

#: The CRC goes by halves of bytes, over a table of 16 places that is made from the polynomial.
_CRC = """list_reduce(list_transform(string_split(regexp_replace(hex(encode(f)), '(.)(.)', '\\2\\1', 'g'), ''), lambda h: cast(strpos('0123456789ABCDEF', h) - 1 as bigint)), lambda c, n: xor(c >> 4, steps[xor(c, n) % 16 + 1]), cast(4294967295 as bigint))"""
OP13 = rf"""with tab as (select list_transform(range(16), lambda i: list_reduce(range(4), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(i as bigint))) steps),
d as (select row_number() over () r, doc_id, regexp_extract_all({_lower('text')}, {_ITEM_WORDS}) w from documents),
b as (select regexp_extract_all({_lower('text')}, {_ITEM_WORDS}) w from benchmark),
g as (select unnest([1, 2, 3]) n),
x as (select r, array_to_string(list_slice(w, i, i + n - 1), ' ') f, count(*) n from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from d, g where len(w) >= n) group by 1, 2),
y as (select array_to_string(list_slice(w, i, i + n - 1), ' ') f, count(*) n from (select w, n, unnest(range(1, len(w) - n + 2)) i from b, g where len(w) >= n) group by 1),
k as (select f, xor({_CRC}, 4294967295) % 10000 k from (select f from x union select f from y), tab),
s as (select k, sum(n) s from x join k using (f) group by 1),
t as (select k, sum(n) t from y join k using (f) group by 1),
gain as (select k, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(n), 0) from x) + 10000) / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(n), 0) from y) + 10000)))) as bigint) gain from s full join t using (k)),
m as (select r, cast(sum(n) as bigint) n_features, cast(sum(n * gain) as bigint) weight from x join k using (f) join gain using (k) group by 1),
z as (select doc_id, len(w) >= 20 may, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
 coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5e0) / 4294967296e0))) as bigint) score from d left join m using (r)),
o as (select *, row_number() over (order by may desc, score desc, doc_id nulls last) o from z)
select doc_id, n_features, weight, score, case when o <= (select 5 * count(*) // 100 from z where may) then o end rank from o"""

ORACLE_SQL |= {"op11_hard_negatives": OP11, "op13_importance_resampling": OP13}
