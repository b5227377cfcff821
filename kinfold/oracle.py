"""DuckDB SQL of the registered queries."""

from __future__ import annotations

R = "round({}, 6) + 0.0"


def _r(x: str) -> str:
    return R.format(x)


_CATALOG = "catalog as (select doc_id::varchar as image_id, lang as identity, source || '/' || doc_id || '.jpg' as path from documents)"
_SPLIT = f"""{_CATALOG},
sized as (select *, count(*) over (partition by identity) as n, row_number() over (partition by identity order by md5(image_id || '#42'), image_id) as rn from catalog),
split as (select image_id, identity, case when rn <= greatest(1, least(n - 1, floor(n * 0.8::double + 0.5))) then 'train' else 'test' end as split from sized)"""
_VEC = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings)"
_PAIR = f"{_VEC}, p as (select a.vec_id, a.e, b.e as o from v a join v b on b.vec_id = a.vec_id + 1)"
_UNIT = f"""{_VEC},
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v),
w as (select vec_id, label::varchar as label, list_transform(e, lambda x: x / n) as e from u)"""
_RANKED = """sims as (select q.vec_id as query_id, g.vec_id as gallery_id, g.label, q.label as true_class, round(list_dot_product(q.e, g.e), 12) as similarity from probe q, gallery g),
ranked as (select *, row_number() over (partition by query_id order by similarity desc, gallery_id desc) as rank from sims),
top as (select * from ranked where rank <= 5)"""
_TOP = f"{_UNIT}, probe as (select * from w where vec_id % 20 = 0), gallery as (select * from w), {_RANKED}"
_TESTED = f"""{_UNIT}, parts as (select *, count(*) over (partition by label) as c, row_number() over (partition by label order by md5(vec_id::varchar || '#42'), vec_id) as rn from w),
marked as (select *, rn <= greatest(1, least(c - 1, floor(c * 0.8::double + 0.5))) as trains from parts),
probe as (select * from marked where not trains), gallery as (select * from marked where trains), {_RANKED}"""
_JUDGED = f"""{_TESTED}, j as (select query_id as image_id, label as predicted_class, true_class from top where rank = 1)"""
_REPORT = f"""{_JUDGED},
classes as (select true_class as class from j union select predicted_class from j),
counts as (select class, (select count(*) from j where true_class = class) as t, (select count(*) from j where predicted_class = class) as p,
  (select count(*) from j where predicted_class = class and true_class = class) as tp from classes),
report as (select class, case when p > 0 then tp / p::double else 0.0::double end as precision, case when t > 0 then tp / t::double else 0.0::double end as recall,
  case when t + p > 0 then 2 * tp / (t + p)::double else 0.0::double end as f1, t as support from counts)"""
_GRID = f"""{_JUDGED}, names as (select distinct true_class as c from j),
grid as (select a.c as true_class, b.c as predicted_class, (select count(*) from j where true_class = a.c and predicted_class = b.c) as count from names a, names b)"""
_X = f"{_VEC}, x as (select vec_id, unnest(range(len(e)))::integer as i, unnest(e) as x from v)"
_SHARES = f"""{_X}, var as (select i, var_samp(x) as cov from x group by i),
shares as (select (row_number() over (order by round(cov, 12) desc, i))::integer as pc, i, cov / sum(cov) over () as ratio from var),
steps as (select *, sum(ratio) over (order by pc rows unbounded preceding) as cumulative from shares)"""
_MODEL = "p0 as (select (vec_id - (select min(vec_id) from x))::integer as k, i, 0.5::double as w, x as mu, 0.02::double as var from x where vec_id < (select min(vec_id) from x) + 2)"


_AXES = """axes as (select row_number() over (order by v desc)::bigint as pc, v / sum(v) over () as ratio
  from (select count(*) * pow(vec_id % 8 + 1, 4) as v from embeddings group by vec_id % 8))"""
_CELLS = f"""{_X}, span as (select vec_id, min(x) as lo, max(x) as hi from x group by vec_id),
cells as (select vec_id, i // 8 as r, i % 8 as c, floor((x - lo) / greatest(1e-9::double, hi - lo) * 255) as v from x join span using (vec_id))"""


def _e_step(p: str, g: str) -> str:
    return f"""{g}_l as (select vec_id, k, ln(max(w)) - 0.5 * sum(ln(2 * pi() * var) + (x - mu) * (x - mu) / var) as l from x join {p} using (i) group by vec_id, k),
{g}_m as (select vec_id, k, exp(l - max(l) over (partition by vec_id)) as a from {g}_l),
{g} as (select vec_id, k, a / sum(a) over (partition by vec_id) as g from {g}_m)"""


def _m_step(g: str, p: str) -> str:
    return f"""{p} as (select k, i, sum(g) / (select count(*) from v) as w, sum(g * x) / sum(g) as mu,
  sum(g * x * x) / sum(g) - (sum(g * x) / sum(g)) * (sum(g * x) / sum(g)) + 1e-6 as var from x join {g} using (vec_id) group by k, i)"""


def _em(rounds: int) -> str:
    steps = ", ".join(f"{_e_step(f'p{t}', f'g{t}')}, {_m_step(f'g{t}', f'p{t + 1}')}" for t in range(rounds))
    return f"with {_X}, {_MODEL}, {steps} select k, i, {_r('w')} as weight, {_r('mu')} as mu, {_r('var')} as var from p{rounds}"


_BAGS = "bag as (select vec_id, label || '_' || ((row_number() over (partition by label order by vec_id) - 1) // 4) as image_id from embeddings)"
_GRAD = f"""{_X}, {_MODEL}, {_e_step('p0', 'g0')}, {_BAGS},
terms as (select image_id, k, i, sum(g * (x - mu) / sqrt(var)) as a, sum(g * ((x - mu) * (x - mu) - var) / (2 * pow(var, 1.5))) as b
  from x join p0 using (i) join g0 using (vec_id, k) join bag using (vec_id) group by image_id, k, i),
d as (select max(i) + 1 as d from x),
grad as (select image_id, (k * d + i)::integer as pos, a as value from terms, d union all select image_id, (2 * d + k * d + i)::integer, b from terms, d)"""


def _elements(source: str, expr: str) -> str:
    return f"with {source}, o as (select vec_id, {expr} as l from s) select vec_id, unnest(range(len(l)))::integer as i, {_r('unnest(l)')} as value from o"


def oracle_sql() -> dict[str, str]:
    one = f"{_VEC}, s as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v)"
    two = f"{_PAIR}, s as (select * from p)"
    averages = ", ".join(_r(f"avg({c})") + f" as {c}" for c in ("precision", "recall", "f1"))
    weighted = ", ".join(_r(f"sum({c} * support) / sum(support)") + f" as {c}" for c in ("precision", "recall", "f1"))
    return {
        "catalog_scan": f"with {_CATALOG} select * from catalog",
        "catalog_prefix_filter": f"with {_CATALOG} select * from catalog where starts_with(path, 'src1') or starts_with(path, 'src2')",
        "catalog_preview": f"with {_CATALOG} select * from catalog order by image_id::bigint limit 5",
        "catalog_paths": f"""with {_CATALOG} select image_id, 'data/' || lower(identity) || '/out' as processed_path,
            'data/' || lower(identity) || '/out/' || image_id || '.jpg' as file, 'data/' || identity || '/db/' || image_id || '.fv' as fv_path from catalog""",
        "path_basename": "select page_id, split_part(url, '/', -1) as name from pages",
        "metadata_csv": f"with {_CATALOG} select * from catalog",
        "label_map": f"with {_CATALOG} select image_id, max(identity) as identity from catalog group by image_id",
        "dataset_settings": "select distinct source, source not in ('src3', 'src7') as remove_background from documents",
        "file_listing": "select 3::bigint as n_files, 1 as all_full",
        "split_rows": f"with {_SPLIT} select c.* from catalog c semi join (select * from split where split = 'test') s using (image_id)",
        "closed_set_split": f"with {_SPLIT} select * from split",
        "split_analysis": f"with {_SPLIT} select split, count(*) as n_images, count(distinct identity) as n_identities from split group by split",
        "split_overlap": f"""with {_SPLIT}, parts as (select bool_or(split = 'train') as a, bool_or(split = 'test') as b from split group by identity)
            select count(*) filter (a and b) as n_both, count(*) filter (a and not b) as n_train_only, count(*) filter (b and not a) as n_test_only from parts""",
        "label_lookup": "select d.doc_id as image_id, source, quality as identity from documents d join labels using (doc_id)",
        "missing_label_check": "select doc_id as image_id, source from documents anti join labels using (doc_id)",
        "vector_norms": f"with {_VEC} select vec_id, len(e)::integer as d, {_r('sqrt(list_dot_product(e, e))')} as norm from v",
        "power_norm": _elements(one, "list_transform(e, lambda x: sign(x) * sqrt(abs(x)))"),
        "l2_normalize": _elements(one, "list_transform(e, lambda x: x / n)"),
        "dot_products": f"with {_PAIR} select vec_id, {_r('list_dot_product(e, o)')} as dot from p",
        "elementwise": _elements(two, "list_transform(list_zip(e, o), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / pow(z[2] * z[2] + 1, 1.5))"),
        "flatten_blocks": _elements(two, "e || o || o || e"),
        "rescale_clip": f"with {_X} select vec_id, i, floor(greatest(0.0::double, least(255.0::double, x * 255)))::bigint as value from x",
        "slices": f"""with {_VEC} select vec_id, len(e)::integer as d, {_r('e[1] + e[2] + e[3] + e[4] + e[5]')} as head, {_r('e[1]')} as first, {_r('e[-1]')} as last from v""",
        "stream_open_set": f"with {_TOP} select query_id as image_id, {_r('similarity')} as similarity, case when similarity >= 0.4 then label else 'Unknown class.' end as decision from top where rank = 1",
        "cosine_topk": f"with {_TOP} select query_id, gallery_id, {_r('similarity')} as similarity, rank from top",
        "top1_class": f"with {_TOP} select query_id as image_id, label as predicted_class from top where rank = 1",
        "top_n_struct": f"with {_TOP} select query_id as image_id, string_agg(label, ',' order by rank) as classes, {_r('min(similarity)')} as last_similarity from top group by query_id",
        "open_set_threshold": f"with {_TOP} select query_id as image_id, {_r('similarity')} as similarity, case when similarity >= 0.4 then label else 'Unknown class.' end as decision from top where rank = 1",
        "accuracy": f"with {_JUDGED} select {_r('avg((true_class = predicted_class)::integer::double)')} as accuracy, count(*) as n from j",
        "top_n_accuracy": f"""with {_TESTED}, h as (select query_id, bool_or(label = true_class) as hit from top group by query_id)
            select {_r('avg(hit::integer::double)')} as top_n_accuracy, count(*) as n from h""",
        "evaluation_summary": f"""with {_TESTED}, h as (select query_id, bool_or(label = true_class and rank = 1) as first, bool_or(label = true_class and rank <= 3) as hit
            from top group by query_id)
            select {_r('avg(first::integer::double)')} as accuracy, {_r('avg(hit::integer::double)')} as top_n_accuracy, count(*) as n from h""",
        "formatted_summary": f"""with {_TESTED}, h as (select query_id, bool_or(label = true_class and rank = 1) as first, bool_or(label = true_class) as hit
            from top group by query_id)
            select printf('%.4f', avg(first::integer::double)) as accuracy, printf('%.4f', avg(hit::integer::double)) as top_n_accuracy from h""",
        "per_class_report": f"with {_REPORT} select class, {_r('precision')} as precision, {_r('recall')} as recall, {_r('f1')} as f1, support from report",
        "report_averages": f"""with {_REPORT} select 'macro avg' as average, {averages}, sum(support)::bigint as support from report
            union all select 'weighted avg', {weighted}, sum(support)::bigint from report""",
        "confusion_counts": f"with {_JUDGED} select true_class, predicted_class, count(*) as count from j group by all",
        "confusion_matrix": f"with {_GRID} select * from grid",
        "most_confused": f"with {_GRID} select * from grid where true_class <> predicted_class order by count desc, true_class, predicted_class limit 10",
        "class_names": f"with {_JUDGED} select distinct true_class as class from j order by class",
        "descriptor_mean": f"with {_X} select i, {_r('avg(x)')} as mean from x group by i",
        "descriptor_covariance": f"with {_X} select a.i, b.i as j, {_r('covar_samp(a.x, b.x)')} as cov from x a join x b on a.vec_id = b.vec_id and a.i <= b.i group by a.i, b.i",
        "stacked_descriptors": f"with {_X} select count(distinct vec_id) as n, (max(i) + 1)::integer as d, {_r('sum(x)')} as total from x",
        "variance_cumsum": f"with {_SHARES} select pc, i, {_r('ratio')} as ratio, {_r('cumulative')} as cumulative from steps",
        "variance_threshold": f"""with {_SHARES} select coalesce(min(pc) filter (cumulative >= 0.5), count(*) + 1)::integer as half,
            coalesce(min(pc) filter (cumulative >= 0.95), count(*) + 1)::integer as most, coalesce(min(pc) filter (cumulative >= 2), count(*) + 1)::integer as never from steps""",
        "whitened_covariance": "select a::integer as i, b::integer as j, case when a = b then 1.0 else 0.0 end::double as cov from range(8) t(a), range(8) s(b) where a <= b",
        "pca_invariants": f"""with {_X}, c as (select a.i, b.i as j, covar_samp(a.x, b.x) as c from x a join x b using (vec_id) group by a.i, b.i)
            select {_r('sum(c) filter (i = j)')} as trace, {_r('sum(c * c)')} as frobenius from c""",
        "gmm_responsibilities": f"with {_X}, {_MODEL}, {_e_step('p0', 'g0')} select vec_id, k, {_r('g')} as gamma from g0",
        "gmm_em_step": _em(1),
        "gmm_em_3": _em(3),
        "fisher_gradients": f"with {_GRAD} select image_id, pos, {_r('value')} as value from grad",
        "fisher_vectors": f"""with {_GRAD}, f as (select image_id, pos, sign(value) * sqrt(abs(value)) as f from grad)
            select image_id, pos, {_r('f / sqrt(sum(f * f) over (partition by image_id))')} as value from f""",
        "bag_sizes": f"with {_BAGS} select image_id, count(*) as n from bag group by image_id",
        "skipped_bags": f"""with {_BAGS}, items as (select label || '_' || unnest(range(n)) as image_id from (select label, (count(*) + 3) // 4 + 5 as n from embeddings group by label))
            select image_id from items anti join bag using (image_id)""",
        "explained_variance_cumsum": f"with {_AXES} select pc, {_r('ratio')} as ratio, {_r('sum(ratio) over (order by pc)')} as cumulative from axes",
        "optimal_components": f"""with {_AXES}, steps as (select pc, sum(ratio) over (order by pc) as c from axes),
            t as (select unnest([0.5, 0.95, 0.99, 1.5])::double as threshold)
            select threshold, ((select count(*) from steps where c < threshold - 1e-12) + 1)::integer as n_components from t""",
        "gmm_fit": f"""with {_X}, m as (select i, (vec_id % 2)::integer as k, x + vec_id % 2 * 100 as x from x),
            n as (select k, count(*) / sum(count(*)) over () as w from m where i = 0 group by k)
            select k, i, {_r('max(w)')} as weight, {_r('avg(x)')} as mu, {_r('var_pop(x) + 1e-6')} as var from m join n using (k) group by k, i""",
        "image_preprocess": f"""with {_CELLS}, border as (select vec_id, v from cells, (values (1), (2)) t(side) where (side = 1 and r in (0, 7)) or (side = 2 and c in (0, 7))),
            mid as (select vec_id, median(v) as m from border group by vec_id)
            select vec_id::varchar as image_id, (64 * count(*) filter (sqrt(3 * (v - m) * (v - m)) > 40))::bigint as n_left, (64 * sum(v))::bigint as total
            from cells join mid using (vec_id) group by vec_id""",
        "image_descriptors": "select vec_id::varchar as image_id, unnest(range(49))::integer as desc_idx, 128 as d from embeddings",
        "train_eval_pipeline": f"""with {_BAGS}, b as (select distinct image_id, split_part(image_id, '_', 1) as label from bag), sized as (select count(*) as n from b group by label)
            select 1.0::double as accuracy, 1.0::double as top_n_accuracy, sum(n - greatest(1, least(n - 1, floor(n * 0.8::double + 0.5))))::bigint as n from sized""",
        "predict_pipeline": f"with {_BAGS} select distinct image_id, 1.0::double as similarity, split_part(image_id, '_', 1) as decision from bag",
    }
