"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from tiersmith.llm.chat_format import Template


def centroids(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2") -> str:
    """Rounds of assigning every vector to the nearest of ``k`` centroids and moving the centroids, written out."""
    steps = [
        f"""
    with kept as (
        select vec_id, sha256('{seed}:' || vec_id) as h, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
        from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    c0 as (select row_number() over (order by h) - 1 as c, v from kept qualify row_number() over (order by h) <= {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} as (
        select vec_id, any_value(v) as v, min({{'d': d, 'c': c}}) as b from (
            select p.vec_id, p.v, m.c, cast(list_sum(list_transform(list_zip(p.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
            from kept p cross join c{i} m)
        group by vec_id)""")
        if i < rounds:
            steps.append(f"""
    s{i} as (
        select c, pos, sum(x) as s, count(*) as n from (
            select b.c as c, unnest(v) as x, generate_subscripts(v, 1) as pos from a{i})
        group by c, pos),
    c{i + 1} as (
        select c{i}.c, coalesce(f.v, c{i}.v) as v from c{i}
        left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by pos) as v from s{i} group by c) f on f.c = c{i}.c)""")
    return (
        ",".join(steps)
        + f"""
    select vec_id, cast(b.c as int) as cluster, b.d as distance,
        cast(sum(b.d) over (partition by b.c) as bigint) as cluster_inertia, cast(sum(b.d) over () as bigint) as inertia,
        sha256(array_to_string(m.v, ',')) as centroid_sha256
    from a{rounds} join c{rounds} m on m.c = b.c"""
    )


def chat_format() -> str:
    """Digests of all turns and of what assistants say, and the length that the template gives a conversation."""
    template = Template()
    pattern = template.pattern(r"(\\*)").replace("'", "''")
    around = " ".join(f"when role = '{role}' then {len(a) + len(b)}" for role, (a, b) in template.roles.items())

    def escaped(col: str) -> str:
        return rf"length(regexp_replace({col}, '{pattern}', '\1\\\2\3', 'g'))"

    return f"""
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    sized as (
        select *, {escaped("text")} + case when role = '{template.default}' then {len(template.stop)} {around}
            else {len("".join(template.named)) + len(template.stop)} + {escaped("role")} end as chars
        from turns)
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
        cast(sum(chars) + {len(template.begin)} as bigint) as formatted_chars,
        cast(0 as bigint) as n_attachments, cast(0 as bigint) as n_tokens
    from sized group by conv_id"""


#: CRC-32 by a table of 256 steps of the reversed polynomial, over the UTF-8 bytes of letters up to U+00FF.
SPELLING = """
    with recursive crc_table as (
        select list(t order by i) as t from (
            select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) as t
            from range(256) r(i))),
    runs as (
        select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w
        from documents),
    counted as (select doc_id, w, count(*) as n from runs where length(w) >= 6 group by doc_id, w),
    checked as (
        select w, n, xor(4294967295, list_reduce(
            list_prepend(4294967295, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || w, ''),
                lambda x: case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [195, cast(unicode(x) as bigint) - 64] end))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
        from counted cross join crc_table),
    spelled as (select case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from checked),
    words as (select word, cast(sum(n) as bigint) as n from spelled where length(word) >= 6 group by word having sum(n) >= 5),
    cuts as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from words, range(1, 200) r(i) where i <= length(word)),
    near as (
        select distinct a.word, a.n, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
        union select a.word, a.n, b.word, b.n from cuts a join words b on a.rest = b.word
        union select b.word, b.n, a.word, a.n from cuts a join words b on a.rest = b.word),
    best as (
        select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
    told as (
        select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n
        from words w left join best b on b.word = w.word),
    way as (
        select word, word as root, form as further from told
        union all select y.word, y.further, t.form from way y join told t on t.word = y.further)
    select t.word, t.form, y.root, t.n, t.n_near, t.form_n from told t join way y on y.word = t.word and y.further is null
"""
