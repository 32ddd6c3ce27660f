"""DuckDB SQL for the operators that SQL can express, over the same tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_HOST = _LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

OP1 = rf"""with recursive tags as (select page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)(<(?:link|meta)\b[^>]*>)', 1)) tag from pages),
links as (select url, regexp_extract(tag, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) target from tags where regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical\b')
    union all select url, regexp_extract(tag, '(?i)url\s*=\s*''?([^"''\s>]+)', 1) from tags where regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh\b')),
urls as (select distinct url from (select url from pages union all select target from links) where url is not null),
parts as (select url, {_HOST} host, {_PATH} path, list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
    lambda p: p <> '' and not regexp_matches(p, '(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)='))) q from urls),
forms as (select url, case when contains(url, '://') then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '(index)?\.html?$', ''), '/+$', '')
    || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end form from parts),
e0 as (select a.form s, b.form d from links l join forms a on a.url = l.url join forms b on b.url = l.target where contains(l.target, '://') and a.form <> b.form),
e as (select s, d from e0 union select d, s from e0),
r(node, c) as (select s, s from e union select e.d, r.c from r join e on e.s = r.node),
comp as (select node, min(c) alias from r group by 1),
p as (select page_id, {_HOST} host, {_PATH} path, f.form from pages left join forms f using (url)),
rules as (select * from (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
    ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) t(rule, rhost, rpath, rverdict)),
fits as (select page_id, arg_max({{'rule': rule, 'verdict': rverdict}}, length(rule)) fit from (select distinct page_id, host, path from p) q join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1),
j as (select p.*, fit, coalesce(alias, form) alias from p left join fits using (page_id) left join comp on comp.node = form),
blocked as (select alias from j where fit is not null and alias is not null group by 1 having not bool_or(fit.verdict = 'allow'))
select page_id, host, path, fit.rule as rule, coalesce(fit.verdict, case when b.alias is not null then 'block' else 'allow' end) verdict, j.alias from j left join blocked b on b.alias = j.alias"""

OP2 = rf"""with d as (select doc_id, source, len({_WORDS.format("coalesce(text, '')")})::bigint size from documents),
s0 as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 i from d group by 1),
s1 as (select *, [5.0::double, 2.0, 1.0][i % 3 + 1] w, 2.0::double * source_size cap, 1.5::double * sum(source_size) over () total from s0),
s2 as (select *, (total - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) level from s1),
s as (select source, source_size, least(cap, coalesce(w * (select level from s2 where w * level < cap order by cap / w, source nulls last limit 1), cap)) target from s2),
t as (select d.*, pass, ('0x' || substr(sha256('mix|' || pass || '|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint u from d, range(2) r(pass)),
f as (select t.doc_id, t.size, case when target > 0 then sum(size) over (partition by t.source order by pass, u, doc_id rows unbounded preceding) / target else 0 end finish from t join s on s.source is not distinct from t.source),
c as (select max(finish) cut from (select finish, sum(sum(size)) over (order by finish) up_to from f group by 1) where up_to <= (select sum(target) from s) + 0.000001),
k as (select doc_id, sum(case when finish <= (select cut from c) then size else 0 end)::bigint taken from f group by 1)
select d.doc_id, d.size, s.source_size, round(s.target, 6) target, k.taken from d join s on s.source is not distinct from d.source join k on k.doc_id = d.doc_id"""

OP5 = """with c as (select conv_id, list({'r': coalesce(role, 'unknown'), 't': coalesce(text, '')} order by turn nulls last, role, text) l from conversations group by 1),
p as (select distinct l[1:i] l from (select l, unnest(range(1, len(l))) i from c)),
k as (select min(conv_id) conv_id, count(*) copies, l from c group by l)
select conv_id, 0::bigint part, len(l) n_turns, copies, array_to_string(list_transform(l, lambda x: '<|im_start|>' || replace(x.r, '<|im_', '<| im_') || chr(10) || replace(x.t, '<|im_', '<| im_') || '<|im_end|>' || chr(10)), '') rendered
from k where not exists (select 1 from p where p.l = k.l)"""

OP9 = f"""with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end s from w),
n as (select doc_id, len(s)::bigint n from s),
x as (select doc_id, unnest(s) g from s),
p as (select a.doc_id a, b.doc_id b, count(*) c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a s, b d from l union all select b, a from l),
r(node, c) as (select doc_id, doc_id from n union select e.d, r.c from r join e on e.s = r.node)
select doc_id, n.n n_shingles, min(r.c) component_id from n join r on r.node = doc_id group by all"""

_CRC = """tab as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) tab)"""


def _crc(text: str) -> str:
    """CRC-32 of an ASCII string; needs the CTE of _CRC in the from list."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8), 4294967295::bigint), 4294967295)"


def _then(cost: str, edit: str, rest: str) -> str:
    return f"(lpad((substr({rest}, 1, 9)::bigint + {cost})::varchar, 9, '0') || '{edit}' || substr({rest}, 10))"


def _closed(g: list[str]) -> str:
    """After insertions before the next row: h0 to h3 from g0 to g3, each a cost of nine digits and the edits to come."""
    i = lambda rest: _then("3", "I", rest)
    h2 = f"least({g[2]}, {i(g[3])}, {i(i(g[2]))})"
    h3 = f"least({g[3]}, {i(g[2])}, {i(i(g[3]))})"
    return f"least({g[0]}, {i(h2)}) h0, least({g[1]}, {i(h2)}) h1, {h2} h2, {h3} h3"


def _row(state: int, keep: dict[str, int], after: int) -> str:
    kept = "".join(f" when init = '{x}' then {_then('extra', 'K', f'h{to}')}" for x, to in keep.items())
    return f"least({_then('4', 'D', f'h{state}')}, case when not must then {_then('3 + extra', 'R', f'h{after}')} end, case when must then null{kept} end)"


OP11 = rf"""with recursive {_CRC},
r as (select conv_id, turn, coalesce(role, ' ') r0, coalesce(text, ' ') t0, {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 k from conversations, tab),
d as (select *, case when k = 4 then 'user' else r0 end as role, case when k = 1 then '' when k = 2 then regexp_replace(t0, '[.!?]', '', 'g') else t0 end as text, unnest(case when k = 3 then [0, 1] else [0] end) c from r where k <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, r0, t0, c) i, row_number() over (partition by conv_id, role, text order by turn nulls first, r0, t0, c) seen,
    left(role, 1) init, regexp_extract(text, '(?s)^.*([^\x20\x09-\x0D])', 1) mark from d),
f as (select *, case when mark = '' then 'blank' when seen > 1 then 'duplicate' when mark not in ('.', '!', '?') then 'truncated' end fault,
    lag(init) over (partition by conv_id order by i) || init pair from n),
v as (select conv_id, i, role, text, init, coalesce(fault in ('blank', 'duplicate'), false) must, case when fault = 'truncated' then 3 else 0 end extra from f),
b(conv_id, i, h0, h1, h2, h3) as (
    select conv_id, max(i) + 1, '000000000', {_then('6', 'II', "'000000000'")}, {_then('3', 'I', "'000000000'")}, '000000000' from v group by 1
    union all select conv_id, i, {_closed(["g0", "g1", "g2", "g3"])} from (
        select b.conv_id, v.i, {_row(0, {"s": 1, "u": 2}, 2)} g0, {_row(1, {"u": 2}, 2)} g1, {_row(2, {"a": 3}, 3)} g2, {_row(3, {"u": 2}, 2)} g3
        from b join v on v.conv_id is not distinct from b.conv_id and v.i = b.i - 1) x),
best as (select conv_id, substr(h0, 1, 9)::bigint cost, substr(h0, 10) audit from b where i = 1),
l as (select conv_id, audit, unnest(range(1, len(audit) + 1)) j from best),
m as (select conv_id, j, substr(audit, j, 1) edit, sum((substr(audit, j, 1) <> 'I')::int) over w i, sum((substr(audit, j, 1) <> 'D')::int) over w e from l window w as (partition by conv_id order by j)),
o as (select m.*, v.role, v.text, bool_or(e = 1 and edit = 'K' and init = 's') over (partition by m.conv_id) headed from m left join v on v.conv_id is not distinct from m.conv_id and v.i = m.i),
t as (select conv_id, sha256(string_agg(case when edit = 'K' then role when (e - headed::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by j)) sha
    from o where edit <> 'D' group by 1),
s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
    count(*) filter (fault = 'truncated') truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal from f group by 1),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
    coalesce(illegal, 0)::bigint illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') audit, coalesce(sha, sha256('')) repaired_sha256
from ids left join s on s.conv_id is not distinct from ids.conv_id left join best on best.conv_id is not distinct from ids.conv_id left join t on t.conv_id is not distinct from ids.conv_id"""

_KEY = _LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")
OP12 = rf"""with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
p as (select r, unnest(l) line, unnest(range(len(l))) place from d),
k as (select r, place, line, {_KEY} as key from p),
bad as (select key from k where key <> '' group by 1 having count(distinct r) >= 10),
m as (select r, place, line, key in (from bad) drop_it from k)
select doc_id, n_lines, n_dropped, sha256(kept) kept_sha256 from d join (
    select r, count(*)::bigint n_lines, count(*) filter (drop_it)::bigint n_dropped, coalesce(string_agg(line, chr(10) order by place) filter (not drop_it), '') kept from m group by r) using (r)"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || coalesce(strlen({text})::varchar || ':' || {text}, '-'))"


OP13 = rf"""with recursive {_CRC},
d as (select row_number() over () r, doc_id, source, {_leaf("text")} leaf, case when {_crc("doc_id::varchar")} % 5 = 0 then {_leaf(_LOWER.format("text"))} end claimed from documents, tab),
s as (select *, coalesce('=' || source, '') tree, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 pos from d),
lv(tree, level, pos, n, digest) as (
    select tree, 0, pos, count(*) over (partition by tree), leaf from s
    union all select tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from lv where n > 1 group by tree, level, n, pos // 16),
sub as (select tree, digest, row_number() over (order by tree) - 1 pos from lv where n = 1),
up(level, pos, n, digest) as (
    select 0, pos, count(*) over (), digest from sub
    union all select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from up where n > 1 group by level, n, pos // 16),
high as (select max(level) high from lv),
nodes as (select tree, level, pos, n, digest from lv where n > 1 union all select null, level + high + 1, pos, n, digest from up, high where n > 1),
near as (select s.r, v.level, v.pos, v.digest, v.pos < s.pos // (16 ** v.level)::bigint before from s join nodes v on v.tree = s.tree and v.pos // 16 = (s.pos // (16 ** v.level)::bigint) // 16
        and v.pos <> s.pos // (16 ** v.level)::bigint
    union all select s.r, v.level, v.pos, v.digest, v.pos < sub.pos // (16 ** (v.level - high - 1))::bigint from s join sub using (tree), high join nodes v on v.tree is null
        and v.pos // 16 = (sub.pos // (16 ** (v.level - high - 1))::bigint) // 16 and v.pos <> sub.pos // (16 ** (v.level - high - 1))::bigint),
steps as (select s.r, v.level from s join (select distinct tree, level from nodes) v on v.tree = s.tree or v.tree is null),
sides as (select r, level, coalesce(string_agg(digest, '' order by pos) filter (before), '') before, coalesce(string_agg(digest, '' order by pos) filter (not before), '') after
    from steps left join near using (r, level) group by all),
ranked as (select *, row_number() over (partition by r order by level) k from sides),
fold(r, k, node) as (select r, 0, coalesce(claimed, leaf) from s union all select x.r, x.k, sha256(x.before || f.node || x.after) from fold f join ranked x on x.r = f.r and x.k = f.k + 1),
ends as (select r, arg_max(node, k) node from fold group by 1),
proof as (select r, sha256(string_agg(before || after, '' order by k)) proof from ranked group by 1)
select doc_id, leaf, sub.digest subroot, root.digest root, coalesce(proof, sha256('')) proof_sha256, node folded_root, node = root.digest verified
from s join sub using (tree) join ends using (r) left join proof using (r), (select digest from up where n = 1) root"""

ORACLES = {"op1_url_filter": OP1, "op2_source_mixing": OP2, "op5_chat_format": OP5, "op9_jaccard_join": OP9,
           "op11_conversation_repair": OP11, "op12_line_dedup": OP12, "op13_merkle_manifest": OP13}
