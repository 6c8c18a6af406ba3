"""DuckDB SQL twins of sampling, statement builders and corpus assembly.

Functions return lists of ``(cte_name, sql)``; names carry a prefix so several
tasks can share one ``WITH`` clause.  These are the oracle's *independent*
formulation: plain window functions over a global order, which Spark's
histogram-based operators must reproduce row for row.
"""

from __future__ import annotations

from claimforge.operators import builders as B
from claimforge.operators.corpus import RECIPES, template_choice
from claimforge.operators.templates import CLASS_NAMES
from claimforge.plans.sqlviews import q, sql_draw, sql_hash

SQL_PREP = {
    "qqp": "select id, text1, text2, label from V_pairs",
    "winogrande": "select id, sentence, option1, option2, answer, label from V_choice",
    "piqa": "select id, sentence as goal, option1 as sol1, option2 as sol2, label from V_choice",
    "mnli": "select id, text1, text2, label from V_nli where label >= 0",
    "snli": "select id, text1, text2, label from V_nli where label >= 0",
    "mintaka": "select id, question, answer from V_qa",
    "yelp_polarity": "select id, text, label, quality from V_bin",
    "wikilingua": "select id, question, answer from V_qa",
    "squad": "select id, context, question, {'text': [answer_text]} as answers from V_span",
    "offensive": "select id, text, label, quality from V_bin",
    "massive": "select id, text, label from V_multi",
    "dpr": "select id, sentence, pronoun, [cand0, cand1] as candidates, label from V_sub",
    "qasc": (
        "select id, question, formatted_question, combinedfact, {'text': list_transform(range(0, 8), "
        "lambda k: concat(choice_stem, '-', cast(k as varchar)))} as choices, answerKey from V_letter"
    ),
    "sciq": "select id, question, correct_answer, distractor1, distractor2, distractor3, support from V_distract",
    "race": (
        "select id, article, question, [opt_a, opt_b, opt_c, opt_d] as options, answer from V_cloze "
        "where instr(question, ' _') > 0"
    ),
    "samsum": "select id, question, answer from V_qa",
}

SQL_VIEWS = {
    "qqp": ["V_pairs"], "winogrande": ["V_choice"], "piqa": ["V_choice"], "mnli": ["V_nli"], "snli": ["V_nli"],
    "mintaka": ["V_qa"], "yelp_polarity": ["V_bin"], "wikilingua": ["V_qa"], "squad": ["V_span"],
    "offensive": ["V_bin"], "massive": ["V_multi"], "dpr": ["V_sub"], "qasc": ["V_letter"],
    "sciq": ["V_distract"], "race": ["V_cloze"], "samsum": ["V_qa"],
}


def fill_expr(tpl: str, values: list[str]) -> str:
    out = tpl
    for i, v in enumerate(values, start=1):
        out = f"replace({out}, '${{{i}}}', {v})"
    return out


def values_table(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return str(v)
        return q(str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(values {body}) t({', '.join(names)})"


def sql_resize(p: str, src_cte: str, n: int, seed, salt: str) -> list[tuple[str, str]]:
    """B3 (B1 when N > n, else B2) over CTE ``src_cte``; result CTE ``{p}_samp``."""
    nrows = f"(select count(*) from {src_cte})"
    return [
        (f"{p}_s1", (
            f"select s.* exclude (rn), s.id as sample_idx from (select *, row_number() over "
            f"(order by {sql_hash(seed, salt, 'id')}, id) as rn from {src_cte}) s "
            f"where rn <= {n} and {nrows} > {n}"
        )),
        (f"{p}_rk", f"select *, row_number() over (order by {sql_hash(seed, salt + ':rank', 'id')}, id) - 1 as pos from {src_cte}"),
        (f"{p}_s2", (
            f"select r.* exclude (pos), i.range as sample_idx from range({n}) i join {p}_rk r "
            f"on r.pos = {sql_draw(seed, salt + ':boot', 'i.range')} % {nrows} where {nrows} <= {n}"
        )),
        (f"{p}_samp", (
            f"select *, cast(id as bigint) as source_id from (select * from {p}_s1 union all by name select * from {p}_s2)"
        )),
    ]


def _pos(seed, task):
    return f"({sql_draw(seed, 'pol:' + task, 'sample_idx')} % 2 = 0)"


def sql_build(p: str, task: str, seed, ch: dict, n: int) -> list[tuple[str, str]]:
    """Statements of one task from ``{p}_samp``; result CTE ``{p}_st`` with the builder output columns."""
    r = RECIPES[task]
    b = r.build
    s = f"{p}_samp"
    ctes: list[tuple[str, str]] = []
    pos = _pos(seed, task)
    if b is B.build_pair_compare:
        rows = [(i, t, True) for i, t in ch["pos"]] + [(100 + i, t, False) for i, t in ch["neg"]]
        body = (
            f"select s.source_id, s.sample_idx, t.template_id, t.pos, {fill_expr('t.tpl', ['s.text1', 's.text2'])} as statement, "
            f"case when t.pos then s.label else 1 - s.label end as is_true from {s} s cross join "
            f"{values_table(rows, ['template_id', 'tpl', 'pos'])}"
        )
    elif b is B.build_multiple_choice:
        o = r.options
        a1, a2 = o["answers"]
        ctes.append((f"{p}_x", (
            f"select *, [{a1}, {a2}][opt + 1] as ans, (cast({o['label']} as int) - {o.get('offset', 0)}) = opt as truth "
            f"from (select *, {sql_draw(seed, 'opt:' + task, 'sample_idx')} % 2 as opt from {s})"
        )))
        rows = [(i, t) for i, t in ch["all"]]
        body = (
            f"select source_id, sample_idx, t.template_id, truth as pos, {fill_expr('t.tpl', [o['question'], 'ans'])} as statement, "
            f"truth as is_true from {p}_x cross join {values_table(rows, ['template_id', 'tpl'])}"
        )
        if o.get("blank_fill"):
            body += (
                f" union all select source_id, sample_idx, {B.BLANK_ID} as template_id, truth as pos, "
                f"replace({o['question']}, '_', ans) as statement, truth as is_true from {p}_x"
            )
    elif b is B.build_class_template:
        k = len(ch)
        rows = [(c, c * 100 + i, t) for c in range(k) for i, t in ch[str(c)]]
        ctes.append((f"{p}_x", (
            f"select *, case when pos then label else (label + 1) % {k} end as cls from (select *, {pos} as pos from {s})"
        )))
        cols = r.options["columns"]
        body = (
            f"select x.source_id, x.sample_idx, t.template_id, x.pos, {fill_expr('t.tpl', ['x.' + c for c in cols])} as statement, "
            f"x.pos as is_true from {p}_x x join {values_table(rows, ['cls', 'template_id', 'tpl'])} on t.cls = x.cls"
        )
    elif b is B.build_shifted_answer:
        nb = max(1, -(-int(n) // 1000))
        ctes.append((f"{p}_x", f"select *, {pos} as pos, {sql_draw(seed, 'blk:' + task, 'sample_idx')} % {nb} as blk from {s}"))
        block = "partition by blk order by sample_idx"
        ctes.append((f"{p}_x1", (
            f"select *, case when lead(sample_idx) over ({block}) is not null and lead(answer) over ({block}) is distinct from answer "
            f"then {{'v': lead(answer) over ({block})}} end as turn, first_value(answer) over ({block}) as head from {p}_x"
        )))
        ctes.append((f"{p}_x2", (
            f"select *, coalesce(first_value(turn ignore nulls) over ({block} rows between current row and unbounded following), "
            f"case when head is distinct from answer then {{'v': head}} end, "
            f"first_value(turn ignore nulls) over ({block} rows between unbounded preceding and unbounded following)) as nxt from {p}_x1"
        )))
        ctes.append((f"{p}_x3", (
            f"select *, case when pos then answer else nxt.v end as ans from {p}_x2 where pos or nxt is not null"
        )))
        body = (
            f"select source_id, sample_idx, t.template_id, pos, {fill_expr('t.tpl', ['question', 'ans'])} as statement, "
            f"pos as is_true from {p}_x3 cross join {values_table(list(ch['all']), ['template_id', 'tpl'])}"
        )
    elif b is B.build_span:
        ctes.append((f"{p}_x", f"select *, {pos} as pos, length(context) as ln from {s}"))
        ctes.append((f"{p}_x2", f"select *, {sql_draw(seed, 'spanlen:' + task, 'sample_idx')} % (ln // 4 + 1) as span from {p}_x"))
        ctes.append((f"{p}_x3", f"select *, {sql_draw(seed, 'spanstart:' + task, 'sample_idx')} % greatest(ln - span, 1) as st from {p}_x2"))
        ctes.append((f"{p}_x4", (
            f"select *, case when pos then answers.text[1] else substring(context, st + 1, span) end as ans from {p}_x3"
        )))
        body = (
            f"select source_id, sample_idx, t.template_id, pos, {fill_expr('t.tpl', ['context', 'question', 'ans'])} as statement, "
            f"pos as is_true from {p}_x4 cross join {values_table(list(ch['all']), ['template_id', 'tpl'])}"
        )
    elif b in (B.build_binary_class, B.build_multi_class):
        names = CLASS_NAMES[r.options["names"]]
        arr = "[" + ", ".join(q(x) for x in names) + "]"
        if b is B.build_binary_class:
            idx = "case when pos then label else 1 - label end"
            ctes.append((f"{p}_x", f"select *, {pos} as pos from {s}"))
        else:
            k = len(names)
            ctes.append((f"{p}_x0", f"select *, {pos} as pos, {sql_draw(seed, 'wrong:' + task, 'sample_idx')} % {k - 1} as r from {s}"))
            ctes.append((f"{p}_x", f"select * from {p}_x0"))
            idx = "case when pos then label else r + case when r >= label then 1 else 0 end end"
        ctes.append((f"{p}_x2", f"select *, {arr}[({idx}) + 1] as ans from {p}_x"))
        body = (
            f"select source_id, sample_idx, t.template_id, pos, {fill_expr('t.tpl', ['text', 'ans'])} as statement, "
            f"pos as is_true from {p}_x2 cross join {values_table(list(ch['all']), ['template_id', 'tpl'])}"
        )
    elif b is B.build_substitution:
        ctes.append((f"{p}_x", (
            f"select *, candidates[(case when pos then label else 1 - label end) + 1] as ans from "
            f"(select *, {pos} as pos from {s})"
        )))
        body = (
            f"select source_id, sample_idx, t.template_id, pos, {fill_expr('t.tpl', ['sentence', 'pronoun', 'ans'])} as statement, "
            f"pos as is_true from {p}_x cross join {values_table(list(ch['all']), ['template_id', 'tpl'])} "
            f"union all select source_id, sample_idx, {B.BLANK_ID} as template_id, pos, "
            f"regexp_replace(sentence, '(?i)\\b\\Q' || pronoun || '\\E\\b', replace(ans, '\\', '\\\\'), 'g') as statement, "
            f"pos as is_true from {p}_x"
        )
    elif b is B.build_lettered_choice:
        ctes.append((f"{p}_x", (
            f"select *, {pos} as pos, ascii(answerKey) - 65 as key, {sql_draw(seed, 'letter:' + task, 'sample_idx')} % 7 as r from {s}"
        )))
        ctes.append((f"{p}_x2", f"select *, case when pos then key else r + case when r >= key then 1 else 0 end end as idx from {p}_x"))
        ctes.append((f"{p}_x3", f"select *, chr(cast(65 + idx as int)) as letter, choices.text[idx + 1] as opt_text from {p}_x2"))
        rows = [(gi, gi * 100 + i, t) for gi, g in enumerate(["g1", "g2", "g3", "g4"]) for i, t in ch.get(g, [])]
        stmt = (
            f"case t.grp when 0 then {fill_expr('t.tpl', ['formatted_question', 'letter'])} "
            f"when 1 then {fill_expr('t.tpl', ['formatted_question', 'opt_text'])} "
            f"when 2 then {fill_expr('t.tpl', ['combinedfact', 'question', 'opt_text'])} "
            f"else {fill_expr('t.tpl', ['combinedfact', 'formatted_question', 'letter'])} end"
        )
        body = (
            f"select source_id, sample_idx, t.template_id, pos, {stmt} as statement, pos as is_true from {p}_x3 "
            f"cross join {values_table(rows, ['grp', 'template_id', 'tpl'])}"
        )
    elif b is B.build_distractor:
        ctes.append((f"{p}_x", (
            f"select *, case when pos then correct_answer else [distractor1, distractor2, distractor3][pick + 1] end as ans "
            f"from (select *, {pos} as pos, {sql_draw(seed, 'distract:' + task, 'sample_idx')} % 3 as pick from {s})"
        )))
        rows = [(0, i, t) for i, t in ch.get("g1", [])] + [(1, 100 + i, t) for i, t in ch.get("g2", [])]
        stmt = (
            f"case t.grp when 0 then {fill_expr('t.tpl', ['question', 'ans'])} "
            f"else {fill_expr('t.tpl', ['support', 'question', 'ans'])} end"
        )
        body = (
            f"select source_id, sample_idx, t.template_id, pos, {stmt} as statement, pos as is_true from {p}_x "
            f"cross join {values_table(rows, ['grp', 'template_id', 'tpl'])}"
        )
    elif b is B.build_cloze_options:
        ctes.append((f"{p}_x", (
            f"select *, {pos} as pos, ascii(answer) - 65 as key, {sql_draw(seed, 'cloze:' + task, 'sample_idx')} % 3 as r from {s}"
        )))
        ctes.append((f"{p}_x2", (
            f"select *, replace(question, '_', options[(case when pos then key else r + case when r >= key then 1 else 0 end end) + 1]) as fq "
            f"from {p}_x"
        )))
        body = (
            f"select source_id, sample_idx, t.template_id, pos, {fill_expr('t.tpl', ['article', 'fq'])} as statement, "
            f"pos as is_true from {p}_x2 cross join {values_table(list(ch['all']), ['template_id', 'tpl'])}"
        )
    else:
        raise ValueError(task)
    ctes.append((f"{p}_b", body))
    ctes.append((f"{p}_st", (
        f"select {q(task)} as task, cast(source_id as bigint) as source_id, cast(sample_idx as bigint) as sample_idx, "
        f"cast(template_id as int) as template_id, case when pos then 'positive' else 'negative' end as polarity, "
        f"statement, cast(is_true as int) as is_true from {p}_b"
    )))
    return ctes


def sql_quotas(p: str, src: str, total: str, parent: list[str], stratum: str) -> list[tuple[str, str]]:
    """Largest-remainder quotas (B4) per ``parent`` over CTE ``src``; CTE ``{p}_quota``.

    ``total`` is a SQL expression (literal or column of ``src`` constant per parent).
    """
    pc = ", ".join(parent)
    part = f"partition by {pc}" if parent else ""
    gb = ", ".join(parent + [stratum])
    tot_sel = f", max({total}) as req" if not total.lstrip("-").isdigit() else f", {total} as req"
    return [
        (f"{p}_cnt", f"select {gb}, count(*) as n{tot_sel} from {src} group by {gb}"),
        (f"{p}_qa", f"select *, sum(n) over ({part}) as tot from {p}_cnt"),
        (f"{p}_qb", f"select *, least(cast(req as bigint), cast(tot as bigint)) as k from {p}_qa"),
        (f"{p}_qc", f"select *, (k * n) // tot as base, (k * n) % tot as rem from {p}_qb"),
        (f"{p}_qd", (
            f"select *, k - sum(base) over ({part}) as lft, row_number() over ({part} order by rem desc, {stratum}) as rr "
            f"from {p}_qc"
        )),
        (f"{p}_quota", f"select {gb}, cast(base + case when rr <= lft then 1 else 0 end as bigint) as quota from {p}_qd"),
    ]


def sql_take_first(p: str, src: str, order_hash: str, ties: list[str], quota_cte: str, group: list[str]) -> list[tuple[str, str]]:
    """Rows with ``row_number() over (partition by group order by hash, ties) <= quota``; CTE ``{p}_take``."""
    part = f"partition by {', '.join(group)}" if group else ""
    using = ", ".join(group)
    return [
        (f"{p}_rn", f"select *, row_number() over ({part} order by {order_hash}, {', '.join(ties)}) as rn_ from {src}"),
        (f"{p}_take", f"select r.* exclude (rn_) from {p}_rn r join {quota_cte} using ({using}) where rn_ <= quota"),
    ]


def sql_stratified(p: str, src: str, total: int | str, seed, salt: str, keys: list[str], stratum="is_true", parent=()) -> list[tuple[str, str]]:
    parent = list(parent)
    ctes = sql_quotas(p, src, str(total), parent, stratum)
    ctes += sql_take_first(p, src, sql_hash(seed, salt, *keys), keys, f"{p}_quota", parent + [stratum])
    return ctes


def sql_task_statements(task: str, n: int, ppc: int, seed) -> list[tuple[str, str]]:
    p = f"t_{task}"
    r = RECIPES[task]
    ctes = [(f"{p}_src", SQL_PREP[task])]
    ctes += sql_resize(p, f"{p}_src", n, seed, f"samp:{task}")
    ctes += sql_build(p, task, seed, template_choice(seed, task, r.template_set, ppc), n)
    return ctes


def sql_task_corpus(task: str, n: int, ppc: int, spc: int, seed) -> list[tuple[str, str]]:
    p = f"t_{task}"
    ctes = sql_task_statements(task, n, ppc, seed)
    ctes += sql_stratified(p, f"{p}_st", spc, seed, f"strat:{task}", ["sample_idx", "template_id"])
    ctes.append((f"{p}_corpus", f"select * from {p}_take"))
    return ctes


def views_for(tasks) -> list[str]:
    out: list[str] = []
    for t in tasks:
        for v in SQL_VIEWS[t]:
            if v not in out:
                out.append(v)
    return out
