"""The derived test tables in SQL, put in front of each oracle query as CTEs."""

from __future__ import annotations

import re

CTES = {
    "answers": """
        select l_orderkey as attempt_id,
               cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey,
                    l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as int) as idx,
               l_partkey as question_id,
               substr('ABCD', cast(l_partkey % 4 as int) + 1, 1) as respuesta_correcta,
               case when l_quantity > 47 then null
                    when l_returnflag <> 'R' then substr('ABCD', cast(l_partkey % 4 as int) + 1, 1)
                    else substr('ABCD', cast((l_partkey + 1) % 4 as int) + 1, 1) end as answer
        from lineitem""",
    "scores": """
        select attempt_id,
               cast(sum(case when answer = respuesta_correcta then 1 else 0 end) as int) as score,
               cast(count(*) as int) as total_questions
        from answers group by attempt_id""",
    "attempts": """
        select o_orderkey as id, concat('student_', cast(o_custkey as varchar)) as student_name,
               o_orderpriority as profile_name,
               concat('unit_', cast(o_orderkey % 3 + 1 as varchar)) as variant_name,
               coalesce(s.score, 0) as score, coalesce(s.total_questions, 0) as total_questions,
               case when coalesce(s.total_questions, 0) > 0
                    then s.score * 20.0e0 / s.total_questions else 0.0e0 end as grade,
               o_orderdate as ts
        from orders left join scores s on s.attempt_id = o_orderkey""",
    "configs": """
        select cast(row_number() over (order by p, u) as int) as id, p as profile_name,
               concat('unit_', cast(u as varchar)) as variant_name,
               cast(case when u = 1 then 1 else 0 end as int) as show_feedback,
               cast(3 + u * 2 as int) as num_preguntas, '["algebra","limits"]' as temas
        from (select distinct o_orderpriority as p from orders) a, unnest([1, 2, 3, 4]) t(u)
        union all
        select cast(21 + p_partkey as int), p_brand, concat('unit_', cast(p_partkey as varchar)),
               cast(p_partkey % 2 as int), cast(3 + p_size % 10 as int),
               concat('["', replace(p_name, ' ', '","'), '","', p_type, '"]')
        from part""",
    "quizzes": """
        select event_id as id, cast(case when user_id % 4 = 0 then user_id % 20 + 1 else 21 + user_id end as int)
                 as config_id,
               date_trunc('minute', ts) as created_at
        from events where event_type = 'signup'""",
    "actions": """
        select event_id as action_id, cast(case when user_id % 4 = 0 then user_id % 20 + 1 else 21 + user_id end as int)
                 as config_id,
               case event_type when 'signup' then 'generate' when 'click' then 'on'
                    else 'off' end as act
        from events where event_type in ('signup', 'click', 'error')""",
    "newest": """
        select config_id, id from (
            select config_id, id, row_number() over (
                partition by config_id order by created_at desc, id desc) as rn from quizzes) r
        where rn = 1""",
    "replayed": """
        select l.config_id, case when l.act <> 'off' then n.id end as active_id
        from (select config_id, arg_max(act, action_id) as act from actions group by 1) l
        left join newest n on n.config_id = l.config_id""",
    "stored_quizzes": """
        select q.id, q.config_id, q.created_at,
               cast(case when r.active_id is not null then 1 else 0 end as int) as is_active
        from quizzes q left join replayed r on r.active_id = q.id""",
    "config_updates": """
        select e.event_id as seq, p.p as profile_name,
               concat('unit_', cast(cast(e.user_id % 5 as int) + 1 as varchar)) as variant_name,
               cast(3 + e.event_id % 10 as int) as num_preguntas,
               cast(e.event_id % 2 as int) as show_feedback
        from events e join (
            select p, row_number() over (order by p) - 1 as pi
            from (select distinct o_orderpriority as p from orders) d) p
          on p.pi = (e.user_id % 25 - e.user_id % 5) / 5
        where e.event_type = 'view' and e.user_id % 25 <> 7""",
    "last_updates": """
        select profile_name, variant_name, arg_max(num_preguntas, seq) as num_preguntas,
               arg_max(show_feedback, seq) as show_feedback, min(seq) as first_seen
        from config_updates group by 1, 2""",
    "upserted": """
        select c.id, c.profile_name, c.variant_name,
               coalesce(u.num_preguntas, c.num_preguntas) as num_preguntas,
               coalesce(u.show_feedback, c.show_feedback) as show_feedback
        from configs c left join last_updates u
          on u.profile_name = c.profile_name and u.variant_name = c.variant_name
        union all
        select cast((select max(id) from configs) + row_number() over (order by first_seen) as int),
               u.profile_name, u.variant_name, u.num_preguntas, u.show_feedback
        from last_updates u where not exists (
            select 1 from configs c where c.profile_name = u.profile_name
            and c.variant_name = u.variant_name)""",
    "ts_text": """
        select event_id as id, case when event_id % 2 = 0 then cast(ts as varchar)
               else concat(replace(cast(ts as varchar), ' ', 'T'), '-04:00') end as timestamp_text
        from events""",
    "raw_items": r"""
        select gen_id, config_id, num_preguntas,
               concat('Here you go: ', case when p_size % 7 = 0 then '' else '[' end,
                      array_to_string(list_transform(range(1, given + 1), lambda k: concat(
                        '{', case when p_size % 13 = 0 and k = 2 then '"titulo":"'
                                  else '"pregunta":"' end,
                        'Concept ', cast(k as varchar), ' ', p_name, ' $', chr(92),
                        case when p_size % 2 = 0 then 'alpha' else 'frac' end, '$",',
                        case when p_size % 5 = 0 and k = given then ''
                             else '"opciones":{"A":"1","B":"2","C":"3","D":"4"},' end,
                        '"respuesta_correcta":"',
                        substr('ABCD', cast((gen_id + k) % 4 as int) + 1, 1),
                        '","explicacion":"', p_brand, '"}')), ','),
                      case when p_size % 7 = 0 then '' else ']' end, ' Done.') as raw_text
        from (select *, greatest(1, num_preguntas - cast(p_size % 11 = 0 as int)) as given
              from (select p_partkey as gen_id, cast(p_partkey // 3 + 1 as int) as config_id,
                           cast((p_partkey // 3 + 1) % 3 + 1 as int) as num_preguntas,
                           p_size, p_name, p_brand from part) p) q""",
    "extracted": r"""
        select gen_id, config_id, num_preguntas, raw_text,
               case when regexp_matches(raw_text, '(?s)\[.*\]')
                    then regexp_extract(raw_text, '(?s)\[.*\]')
                    else trim(replace(replace(trim(raw_text), '```json', ''), '```', ''))
               end as doc
        from raw_items""",
    "repaired": r"""
        select gen_id, config_id, num_preguntas,
               regexp_replace(regexp_replace(doc, '(^|[^\\])\\([^\x22\\/bfnrt]|$)', '\1\\\\\2', 'g'),
                              '(^|[^\\])\\([^\x22\\/bfnrt]|$)', '\1\\\\\2', 'g') as doc
        from extracted""",
    "validated": """
        select gen_id, config_id, num_preguntas, doc,
               coalesce(whole and len(json_extract(doc, '$[*].pregunta')) = num_preguntas, false)
                 as lenient,
               coalesce(whole and len(json_extract(doc, '$[*].pregunta')) = num_preguntas
                   and len(json_extract(doc, '$[*].opciones')) = num_preguntas
                   and len(json_extract(doc, '$[*].respuesta_correcta')) = num_preguntas, false)
                 as strict
        from (select *, json_type(doc) = 'ARRAY' and json_array_length(doc) = num_preguntas
                as whole
              from (select gen_id, config_id, num_preguntas,
                           case when json_valid(doc) then doc end as doc from repaired) r) w""",
    "tries": """
        select gen_id, config_id, doc, lenient, strict,
               row_number() over (partition by config_id order by gen_id) as attempt
        from validated""",
}


def with_ctes(sql: str) -> str:
    """The query preceded by the derived tables it reads, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if re.search(rf"\b(from|join)\s+{name}\b", text) and name not in needed:
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} as ({CTES[name]})" for name in needed)
    own = sql.strip()
    return f"with {ctes},\n{own[5:]}" if own.startswith("with ") else f"with {ctes}\n{own}"
