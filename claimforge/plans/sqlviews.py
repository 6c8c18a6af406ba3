"""SQL twins of the stand-in views (DuckDB dialect) and a CTE composer.

The oracle runs on DuckDB with only the driver tables registered, so every
oracle statement carries the views it needs as a ``WITH`` prefix.
"""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "V_docs": "select doc_id as id, text, lang, source, n_chars from documents",
    "V_bin": "select d.id, d.text, l.toxic as label, l.quality from V_docs d join labels l on l.doc_id = d.id",
    "V_multi": (
        "select id, text, case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end as label from V_docs"
    ),
    "V_pairs": (
        "select a.id, a.text as text1, b.text as text2, case when a.lang = b.lang then 1 else 0 end as label "
        "from V_docs a join V_docs b on b.id = a.id + 1"
    ),
    "V_nli": "select id, text1, text2, case when id % 20 = 0 then -1 else id % 3 end as label from V_pairs",
    "V_qa": (
        "select u.conv_id * 4294967296 + u.turn as id, u.text as question, a.text as answer "
        "from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 "
        "where u.role = 'user' and a.role = 'assistant'"
    ),
    "V_choice": (
        "select p_partkey as id, concat('the _ item is ', p_name) as sentence, p_brand as option1, p_type as option2, "
        "cast(1 + p_partkey % 2 as varchar(1)) as answer, p_partkey % 2 as label from part"
    ),
    "V_span": (
        "select doc_id as id, text as context, split_part(text, '.', 1) as question, "
        "split_part(text, ' ', 2) as answer_text from documents where text is not null"
    ),
    "V_sub": (
        "select p_partkey as id, concat(p_name, ' met ', p_brand, ' when It won; it left the pit') as sentence, "
        "'it' as pronoun, p_name as cand0, p_brand as cand1, p_partkey % 2 as label from part"
    ),
    "V_letter": (
        "select p_partkey as id, concat('pick ', p_name) as question, concat('pick ', p_name, ' (A) .. (H)') as "
        "formatted_question, p_type as combinedfact, p_brand as choice_stem, chr(cast(65 + p_partkey % 8 as int)) "
        "as answerKey from part"
    ),
    "V_distract": (
        "select p_partkey as id, concat('type of ', p_name) as question, p_type as correct_answer, p_brand as "
        "distractor1, p_name as distractor2, 'none' as distractor3, concat(p_name, ' is made as ', p_type) as support "
        "from part"
    ),
    "V_cloze": (
        "select p_partkey as id, p_name as article, case when p_partkey % 2 = 0 then concat('the _ ', p_name) else "
        "p_name end as question, p_brand as opt_a, p_type as opt_b, 'plain' as opt_c, 'none' as opt_d, "
        "chr(cast(65 + p_partkey % 4 as int)) as answer from part"
    ),
    "V_copa": (
        "select id, text1 as premise, split_part(text2, '.', 1) as choice1, substring(text2, length(split_part(text2, '.', 1)) + 2) as choice2, "
        "case when id % 2 = 0 then 'cause' else 'effect' end as question, id % 2 as label from V_pairs"
    ),
    "V_story": (
        "select id, split_part(text1, '.', 1) as input_sentence_1, split_part(text1, '.', 2) as input_sentence_2, "
        "split_part(text1, '.', 3) as input_sentence_3, split_part(text1, '.', 4) as input_sentence_4, "
        "array_to_string(string_split(text1, '.')[5:], '.') as sentence_quiz1, "
        "array_to_string(string_split(text2, '.')[5:], '.') as sentence_quiz2, "
        "1 + id % 2 as answer_right_ending from V_pairs"
    ),
    "V_topic": (
        "select id, split_part(text, '.', 1) as title, substring(text, length(split_part(text, '.', 1)) + 2) as content, "
        "id % 10 as label from V_docs"
    ),
    "V_emotion": "select id, text, id % 6 as label from V_docs",
    "V_runs": (
        "select event_id as run_id, event_id % 5 as model_no, event_type as dataset, case when user_id % 2 = 0 then "
        "'org/base' else 'large' end as model, case event_id % 6 when 0 then '0' when 1 then '32' when 2 then '200' "
        "when 3 then '500' when 4 then '1000' else 'full' end as shot, case user_id % 9 when 0 then 1000 when 1 then "
        "2000 when 2 then 3000 when 3 then 4000 when 4 then 5000 when 5 then 10000 when 6 then 20000 when 7 then "
        "40000 else 50000 end as SPC, 5 as PPC, case when user_id % 7 = 0 then 'a,b' end as excluded, "
        "cast(cast(round(value * 100) as bigint) % 1000 as double) / 1000 as accuracy, 10 + event_id % 90 as "
        "n_examples, cast(1 + user_id % 4 as double) as seconds from events"
    ),
    "V_wide_baseline": (
        "select dataset as eval_set, 'base' as model, concat(cast(max(case when shot='full' then run_id % 100 end) as "
        "varchar(9)), '%') as full_shot, concat(cast(max(case when shot='1000' then run_id % 100 end) as varchar(9)), "
        "'%') as shot_1000, concat(cast(max(case when shot='0' then run_id % 100 end) as varchar(9)), '%') as shot_0 "
        "from V_runs group by dataset"
    ),
    "V_speed_wide": (
        "select model, avg(case when dataset='click' then n_examples/seconds end) as click, avg(case when "
        "dataset='view' then n_examples/seconds end) as view, avg(case when dataset='error' then n_examples/seconds "
        "end) as error from V_runs group by model"
    ),
}

VIEW_DEPS: dict[str, list[str]] = {
    "V_bin": ["V_docs"],
    "V_multi": ["V_docs"],
    "V_pairs": ["V_docs"],
    "V_nli": ["V_pairs"],
    "V_topic": ["V_docs"],
    "V_emotion": ["V_docs"],
    "V_copa": ["V_pairs"],
    "V_story": ["V_pairs"],
    "V_wide_baseline": ["V_runs"],
    "V_speed_wide": ["V_runs"],
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in VIEW_DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(views, ctes: list[tuple[str, str]], body: str) -> str:
    """``WITH <views in dependency order>, <extra named CTEs> <body>``."""
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in _closure(views)]
    parts += [f"{n} AS ({sql})" for n, sql in ctes]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_hash(seed, salt: str, *keys: str) -> str:
    ks = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"md5(concat_ws(':', {q(str(seed))}, {q(salt)}, {ks}))"


def sql_draw(seed, salt: str, *keys: str) -> str:
    return f"('0x' || substr({sql_hash(seed, salt, *keys)}, 1, 8))::BIGINT"


def sql_shuffle(text: str, seed, salt: str, key: str) -> str:
    """Words of ``text`` in the order of their mixed keys (the twin of ``shuffle_words``)."""
    h = f"md5(concat_ws(':', {q(str(seed))}, {q(salt)}, cast({key} as varchar)))"
    a, b = (f"('0x' || substr({h}, {k}, 8))::BIGINT" for k in (1, 9))
    mixed = f"(({a} + (i - 1) * 2654435761) % 2147483647) * (({b} + (i - 1) * 40503) % 2147483629) % 2147483587"
    words = f"list_filter(regexp_split_to_array({text}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
    return (
        f"array_to_string(list_transform(list_sort(list_transform({words}, lambda w, i: {{'h': {mixed}, 'i': i - 1, 'w': w}})), lambda s: s.w), ' ')"
    )


def sql_fill(template: str, values: list[str]) -> str:
    out = q(template)
    for i, v in enumerate(values, start=1):
        out = f"replace({out}, '${{{i}}}', {v})"
    return out


def sql_double(x: float) -> str:
    return f"CAST({repr(float(x))} AS DOUBLE)"
