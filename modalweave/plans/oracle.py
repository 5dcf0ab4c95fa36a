"""The same queries as DuckDB SQL on the same tables (views named as the files)."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def i64(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def elements(vec: str, n: int, prefix: str) -> str:
    return ", ".join(r6(f"{vec}[{i + 1}]", f"{prefix}{i}") for i in range(n))


def add(name: str, *ctes_and_query: str) -> None:
    *ctes, query = ctes_and_query
    ORACLE[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + query


def indexed(keys: str, source: str, vec: str, name: str, n: int | str = 64) -> str:
    """One row per element of the list column ``vec``."""
    size = f"len({vec})" if isinstance(n, str) else n
    return (
        f"SELECT {keys}, CAST(k AS BIGINT) AS idx, round({vec}[k + 1], 6) + 0.0 AS {name} "
        f"FROM (SELECT *, unnest(range({size})) AS k FROM {source})"
    )


# --- shared tables ------------------------------------------------------------------------

RATE = "(length(text) - length(regexp_replace(text, '[{}]', '', 'g'))) / greatest(length(text), 1)"
RATES = ", ".join(RATE.format(c) for c in ("aeiou", "äöüß", "éèêàçù", "áíóúñ¿¡", " "))
LANG_ID = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END"

META = (
    "meta AS (SELECT doc_id AS cell_id, n_chars % 3 AS day, CAST(substr(source, 4) AS BIGINT) % 3 AS donor, "
    f"'text' AS technology, lang AS cell_type, {LANG_ID} AS y FROM documents)"
)
PROTEIN = f"protein AS (SELECT doc_id AS cell_id, [{RATES}, ln(1 + length(text)) / 10] AS p FROM documents)"
RNA = "rna AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS r FROM embeddings)"
TAGS = "tags AS (SELECT doc_id AS cell_id, [CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)] AS t FROM labels)"
SPLIT = (
    "folds AS (SELECT DISTINCT donor AS fold FROM meta), "
    "ranked AS (SELECT fold, cell_id, donor, y, donor = fold AS is_test, "
    "row_number() OVER (PARTITION BY fold, donor = fold ORDER BY md5('42:' || cell_id), cell_id) AS rn, "
    "count(*) OVER (PARTITION BY fold, donor = fold) AS n FROM meta, folds), "
    "split AS (SELECT fold, cell_id, donor, y, CASE WHEN is_test THEN 'test' "
    "WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS split FROM ranked)"
)
PAIR = "pair AS (SELECT m.*, donor AS fold, p, r FROM meta m JOIN protein USING (cell_id) JOIN rna USING (cell_id))"
THREE = "three AS (SELECT m.*, p, r, t FROM meta m JOIN protein USING (cell_id) JOIN rna USING (cell_id) JOIN tags USING (cell_id))"
EMB = "emb AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
TYPE_ID = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"
PREDS = (
    "preds AS (SELECT event_id AS cell_id, user_id % 3 AS fold, (user_id % 25 + 1) * 10 AS epoch, "
    "CASE WHEN event_id % 2 = 0 THEN 'protein' ELSE 'rna' END AS modality, "
    f"{TYPE_ID} AS y_true, "
    f"CASE WHEN event_id % 10 < 7 THEN {TYPE_ID} ELSE (event_id * 7) % 5 END AS y_pred, "
    "(event_id % 97 + 1) / CAST(100 AS DOUBLE) AS tcp_true, "
    "((event_id * 31) % 101) / CAST(100 AS DOUBLE) AS tcp_pred FROM events)"
)
LOGITS = "logits AS (SELECT *, [sin(CAST(cell_id + 3 * k AS DOUBLE)) for k in range(5)] AS z FROM preds)"
TOKENS = (
    "tokens AS (SELECT conv_id, turn, length(text) / CAST(100 AS DOUBLE) AS score, "
    "CAST(length(text) AS DOUBLE) AS v0, CAST(turn AS DOUBLE) AS v1, "
    "CASE WHEN role = 'user' THEN CAST(1 AS DOUBLE) ELSE 0 END AS v2 FROM conversations)"
)
PIXELS = (
    "pixels AS (SELECT vec_id AS img, CAST(k // 8 AS BIGINT) AS y, CAST(k % 8 AS BIGINT) AS x, "
    "CAST(0 AS BIGINT) AS c, CAST(embedding[k + 1] AS DOUBLE) AS v "
    "FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings))"
)
LSE = "(list_max({z}) + ln(list_sum([exp(v - list_max({z})) for v in {z}])))"
SOFTMAX = "[exp(v - list_max({z})) / list_sum([exp(u - list_max({z})) for u in {z}]) for v in {z}]"


def affine(x: str, n_in: int, n_out: int, layer: int) -> str:
    row = f"[sin(7 * i + 13 * j + {layer}) / 8 for i in range({n_in})]"
    return f"[list_inner_product({x}, {row}) + cos(j + {layer}) / 8 for j in range({n_out})]"


# --- preparation --------------------------------------------------------------------------

add(
    "meta_join_modality",
    META,
    PROTEIN,
    f"SELECT cell_id, cell_type, donor, {elements('p', 6, 'f')} FROM meta JOIN protein USING (cell_id)",
)
add(
    "early_fusion_join",
    META,
    PROTEIN,
    RNA,
    PAIR,
    "SELECT cell_id, donor, cell_type, CAST(len(p) + len(r) AS BIGINT) AS n_features, "
    f"{r6('list_sum(p) + list_sum(r)', 'total')}, {r6('p[1]', 'first')}, {r6('r[64]', 'last')} FROM pair",
)
add(
    "early_fusion_meta_keys",
    META,
    PROTEIN,
    RNA,
    "a AS (SELECT * EXCLUDE (y) FROM meta JOIN protein USING (cell_id))",
    "b AS (SELECT * EXCLUDE (y) FROM meta JOIN rna USING (cell_id))",
    "SELECT a.cell_id, a.day, a.donor, a.technology, a.cell_type, "
    f"{r6('list_sum(p)', 'protein_total')}, {r6('list_sum(r)', 'rna_total')} FROM a JOIN b ON a.cell_id = b.cell_id "
    "AND a.day = b.day AND a.donor = b.donor AND a.technology = b.technology AND a.cell_type = b.cell_type",
)
add(
    "three_way_fusion_join",
    META,
    PROTEIN,
    RNA,
    TAGS,
    THREE,
    "SELECT cell_id, donor, CAST(len(p) + len(r) + len(t) AS BIGINT) AS n_features, "
    f"{r6('list_sum(p) + list_sum(r) + list_sum(t)', 'total')} FROM three",
)
add(
    "sample_aligned",
    META,
    PROTEIN,
    RNA,
    TAGS,
    THREE,
    f"SELECT cell_id, {i64('y')}, {i64('len(p)', 'protein_width')}, {i64('len(r)', 'rna_width')}, "
    f"{i64('len(t)', 'tags_width')}, {elements('t', 2, 'tag')} FROM three",
)
add(
    "missing_modality_rows",
    META,
    PROTEIN,
    RNA,
    TAGS,
    "j AS (SELECT cell_id, p IS NOT NULL AS has_protein, r IS NOT NULL AS has_rna, t IS NOT NULL AS has_tags "
    "FROM meta LEFT JOIN protein USING (cell_id) LEFT JOIN rna USING (cell_id) LEFT JOIN tags USING (cell_id))",
    "SELECT *, CAST(has_protein AS BIGINT) + CAST(has_rna AS BIGINT) + CAST(has_tags AS BIGINT) AS n_present FROM j",
)
add(
    "first_line_in_file",
    f"SELECT {i64('l_suppkey')}, {i64('l_orderkey')}, {i64('l_linenumber')} FROM (SELECT *, row_number() OVER () AS rn FROM lineitem) "
    "QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY rn) = 1",
)
add(
    "dedup_keep_first",
    "SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
    "l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
    "strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
    "l_shipdate) AS rn FROM lineitem) WHERE rn = 1",
)
add("semi_join_ids", META, f"SELECT cell_id, {i64('y')} FROM meta WHERE cell_id IN (SELECT doc_id FROM labels)")
add("fold_list", META, "SELECT DISTINCT donor AS fold FROM meta")
add("lodo_split", META, SPLIT, "SELECT fold, cell_id, split = 'test' AS is_test FROM split")
add("train_val_split", META, SPLIT, "SELECT fold, cell_id, split FROM split")
add(
    "fold_membership",
    META,
    SPLIT,
    "SELECT cell_id, any_value(donor) AS test_fold, "
    "count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, "
    "coalesce(string_agg(CAST(fold AS VARCHAR), ',' ORDER BY fold) FILTER (WHERE split = 'train'), '') AS train_in "
    "FROM split GROUP BY cell_id",
)
add(
    "hash_val_split",
    META,
    "SELECT cell_id, CAST('0x' || substr(md5('42:' || cell_id), 1, 8) AS BIGINT) % 100 < 20 AS is_val FROM meta",
)
add("split_sizes", META, SPLIT, f"SELECT fold, split, {i64('y')}, count(*) AS n FROM split GROUP BY ALL")
add(
    "split_by_modality",
    META,
    PROTEIN,
    RNA,
    TAGS,
    SPLIT,
    "m AS (SELECT cell_id, 'protein' AS modality, p AS v FROM protein UNION ALL SELECT cell_id, 'rna', r FROM rna "
    "UNION ALL SELECT cell_id, 'tags', t FROM tags)",
    "SELECT fold, split, modality, count(*) AS n, CAST(sum(y) AS BIGINT) AS y_sum, "
    f"{r6('sum(list_sum(v))', 'total')} FROM split JOIN m USING (cell_id) GROUP BY fold, split, modality",
)
WEIGHTS = (
    "grid AS (SELECT fold, CAST(k AS BIGINT) AS y FROM folds, range({k}) AS r(k)), "
    "counts AS (SELECT g.fold, g.y, count(s.cell_id) AS n FROM grid g LEFT JOIN split s "
    "ON s.fold = g.fold AND s.y = g.y AND s.split = 'train' GROUP BY g.fold, g.y), "
    "weights AS (SELECT fold, y, n, n / sum(n) OVER (PARTITION BY fold) AS frequency, "
    "sum(n) OVER (PARTITION BY fold) / nullif(n, 0) AS weight FROM counts)"
)
add(
    "class_weights",
    META,
    SPLIT,
    WEIGHTS.format(k=4),
    f"SELECT fold, y, n, {r6('frequency')}, {r6('weight')} FROM weights",
)
BATCH = "CAST('0x' || substr(md5(epoch || ':' || cell_id), 1, 8) AS BIGINT) % "
add(
    "minibatch_counts",
    META,
    SPLIT,
    "sized AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY fold) / 64.0) AS BIGINT) AS nb FROM split "
    "WHERE split = 'train')",
    "epochs AS (SELECT *, unnest(range(1, 4)) AS epoch FROM sized)",
    f"SELECT fold, epoch, {BATCH} nb AS batch, count(*) AS n FROM epochs GROUP BY ALL",
)
add("label_map", META, f"SELECT cell_id, cell_type, {i64('y')} FROM meta")
add(
    "drop_columns",
    META,
    PROTEIN,
    f"SELECT cell_id, {i64('y')}, {elements('p', 6, 'f')} FROM meta JOIN protein USING (cell_id)",
)
add(
    "modality_width",
    PROTEIN,
    RNA,
    TAGS,
    "SELECT 'protein' AS modality, 'tabular' AS kind, CAST(max(len(p)) AS BIGINT) AS width, count(*) AS n_rows "
    "FROM protein UNION ALL SELECT 'rna', 'tabular', CAST(max(len(r)) AS BIGINT), count(*) FROM rna "
    "UNION ALL SELECT 'tags', 'tabular', CAST(max(len(t)) AS BIGINT), count(*) FROM tags "
    "UNION ALL SELECT 'image', 'image', CAST(max(len(r)) AS BIGINT), count(*) FROM rna",
)
add(
    "named_features",
    PROTEIN,
    "SELECT cell_id, CAST(k AS BIGINT) AS idx, "
    "['vowel', 'german', 'french', 'spanish', 'space', 'log_length'][k + 1] AS name, "
    f"{r6('p[k + 1]', 'value')} FROM (SELECT *, unnest(range(6)) AS k FROM protein)",
)
ORDERS = (
    "meta AS (SELECT o_orderkey AS cell_id, o_custkey % 3 AS donor, o_custkey, "
    "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS y FROM orders)"
)
add(
    "orders_fused",
    ORDERS,
    "lines AS (SELECT l_orderkey, [CAST(count(*) AS DOUBLE), sum(l_quantity), avg(l_extendedprice), avg(l_discount), "
    "avg(l_tax)] AS f FROM lineitem GROUP BY l_orderkey)",
    "j AS (SELECT cell_id, donor, y, list_concat(f, [c_acctbal, CAST(c_nationkey AS DOUBLE)]) AS f FROM meta "
    "JOIN lines ON cell_id = l_orderkey JOIN customer ON o_custkey = c_custkey)",
    f"SELECT cell_id, donor, y, {elements('f', 7, 'f')} FROM j",
)
add("orders_split_sizes", ORDERS, SPLIT, "SELECT fold, split, y, count(*) AS n FROM split GROUP BY ALL")
add(
    "orders_class_weights",
    ORDERS,
    SPLIT,
    WEIGHTS.format(k=5),
    f"SELECT fold, y, n, {r6('frequency')}, {r6('weight')} FROM weights",
)

# --- vector functions ---------------------------------------------------------------------

add(
    "sigmoid_gate",
    EMB,
    "g AS (SELECT cell_id, [v / (1 + exp(-v)) for v in x] AS g FROM emb)",
    indexed("cell_id", "g", "g", "gated"),
)
add(
    "relu_vec",
    EMB,
    "g AS (SELECT cell_id, [greatest(v, 0) for v in x] AS g FROM emb)",
    indexed("cell_id", "g", "g", "relu"),
)
add("cast_features", EMB, f"SELECT cell_id, true AS same, {r6('list_sum(x)', 'total')} FROM emb")
PROBS = f"probs AS (SELECT *, {SOFTMAX.format(z='z')} AS p FROM logits)"
add("softmax_probs", PREDS, LOGITS, PROBS, f"SELECT cell_id, {elements('p', 5, 'p')} FROM probs")
add(
    "resoftmax_argmax",
    PREDS,
    LOGITS,
    PROBS,
    f"again AS (SELECT *, {SOFTMAX.format(z='p')} AS pp FROM probs)",
    "SELECT cell_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS once, "
    "CAST(list_position(pp, list_max(pp)) - 1 AS BIGINT) AS twice FROM again",
)
add("true_class_prob", PREDS, LOGITS, PROBS, f"SELECT cell_id, fold, {r6('p[y_true + 1]', 'tcp')} FROM probs")
add(
    "one_hot",
    PREDS,
    "SELECT cell_id, " + ", ".join(f"CAST(y_true = {k} AS DOUBLE) AS h{k}" for k in range(5)) + " FROM preds",
)
add(
    "argmax_pred",
    PREDS,
    LOGITS,
    "q AS (SELECT *, [round(v, 0) + 0.0 for v in z] AS q FROM logits)",
    "SELECT cell_id, CAST(list_position(z, list_max(z)) - 1 AS BIGINT) AS y_pred, "
    "CAST(list_position(q, list_max(q)) - 1 AS BIGINT) AS first_of_ties FROM q",
)
add(
    "weighted_concat",
    META,
    PROTEIN,
    RNA,
    TAGS,
    THREE,
    "w AS (SELECT cell_id, list_concat(list_concat([v * 3 for v in p], r), [v * 6 for v in t]) AS v FROM three)",
    indexed("cell_id", "w", "v", "value", 72),
)
add(
    "confidence_scale",
    EMB,
    "s AS (SELECT cell_id, [v * sin(cell_id) for v in x] AS s FROM emb)",
    indexed("cell_id", "s", "s", "scaled"),
)
NORMED = (
    "centred AS (SELECT cell_id, x, [v - list_sum(x) / len(x) for v in x] AS c FROM emb), "
    "normed AS (SELECT cell_id, x, [v / sqrt(list_inner_product(c, c) / len(c) + 1e-5) for v in c] AS n FROM centred)"
)
add("layer_norm", EMB, NORMED, indexed("cell_id", "normed", "n", "normed"))
add(
    "residual_add",
    EMB,
    NORMED,
    "s AS (SELECT cell_id, [x[i] + n[i] for i in range(1, 65)] AS s FROM normed)",
    f"SELECT cell_id, {elements('s', 8, 's')}, {r6('list_sum(s)', 'total')} FROM s",
)
add(
    "fourier_encode",
    "e AS (SELECT event_id, event_id % 100 / CAST(100 AS DOUBLE) AS p FROM events)",
    f"SELECT event_id, {r6('sin(pi() * p)', 'e0')}, {r6('sin(2 * pi() * p)', 'e1')}, {r6('cos(pi() * p)', 'e2')}, "
    f"{r6('cos(2 * pi() * p)', 'e3')}, {r6('p', 'e4')} FROM e",
)
add(
    "mask_modality",
    META,
    RNA,
    SPLIT,
    "m AS (SELECT fold, cell_id, split, CASE WHEN split = 'test' THEN [CAST(0.5 AS DOUBLE) for v in r] ELSE r END AS m "
    "FROM split JOIN rna USING (cell_id))",
    f"SELECT fold, cell_id, split, {elements('m', 4, 'm')}, {r6('list_sum(m)', 'total')} FROM m",
)
add(
    "error_terms",
    PREDS,
    f"SELECT cell_id, {r6('abs(tcp_true - tcp_pred)', 'abs_error')}, {r6('(tcp_true - tcp_pred) ** 2', 'sq_error')}, "
    f"{r6('abs(tcp_true - tcp_pred) / tcp_true', 'rel_error')} FROM preds",
)
add(
    "vector_distance",
    EMB,
    NORMED,
    f"SELECT cell_id, {r6('list_distance(x, n)', 'distance')} FROM normed JOIN documents ON doc_id = cell_id",
)

# --- evaluation ---------------------------------------------------------------------------


def confusion(by: str) -> str:
    return f"cm AS (SELECT {by}, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL)"


def per_class(by: str) -> str:
    return (
        f"sides AS (SELECT {by}, y_true AS label, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, n AS support, "
        f"0 AS predicted FROM cm UNION ALL SELECT {by}, y_pred, 0, 0, n FROM cm), "
        f"sums AS (SELECT {by}, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support, "
        "CAST(sum(predicted) AS BIGINT) AS predicted FROM sides GROUP BY ALL), "
        "prf AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, "
        "coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 "
        "FROM sums)"
    )


def metrics(by: str) -> str:
    return (
        f"metrics AS (SELECT {by}, sum(f1 * support) / sum(support) AS f1, avg(f1) AS f1_macro, "
        "sum(recall * support) / sum(support) AS recall, sum(precision * support) / sum(support) AS precision, "
        "sum(tp) / sum(support) AS accuracy, avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy "
        f"FROM prf GROUP BY {by})"
    )


METRICS = ["f1", "f1_macro", "recall", "precision", "accuracy", "balanced_accuracy"]
SIX = ", ".join(r6(m) for m in METRICS)
MEAN_STD = ", ".join(
    r6(f"{f}({m})", f"{m}_{s}") for f, s in (("avg", "mean"), ("stddev_samp", "sd_samp")) for m in METRICS
)
FOLD_GRID = (
    "grid AS (SELECT f.fold, CAST(a AS BIGINT) AS y_true, CAST(b AS BIGINT) AS y_pred, coalesce(n, 0) AS n "
    "FROM (SELECT DISTINCT fold FROM preds) f CROSS JOIN range(5) AS ra(a) CROSS JOIN range(5) AS rb(b) "
    "LEFT JOIN cm ON cm.fold = f.fold AND cm.y_true = a AND cm.y_pred = b)"
)
add("confusion_matrix", PREDS, confusion("fold"), FOLD_GRID, "SELECT * FROM grid")
add(
    "confusion_out_of_grid",
    PREDS,
    "seen AS (SELECT fold, nullif(CAST(y_true AS BIGINT), 1) AS y_true, CAST(y_pred AS BIGINT) AS y_pred, 1 AS n "
    "FROM preds UNION ALL SELECT fold, a, b, 0 FROM (SELECT DISTINCT fold FROM preds), range(3) AS ra(a), "
    "range(3) AS rb(b))",
    "SELECT fold, y_true, y_pred, CAST(sum(n) AS BIGINT) AS n FROM seen GROUP BY fold, y_true, y_pred",
)
add(
    "confusion_wide",
    PREDS,
    "SELECT CAST(y_true AS BIGINT) AS y_true, "
    + ", ".join(f"count(*) FILTER (WHERE y_pred = {k}) AS pred{k}" for k in range(5))
    + " FROM preds GROUP BY y_true",
)
add(
    "confusion_mean_std",
    PREDS,
    confusion("fold"),
    FOLD_GRID,
    f"SELECT y_true, y_pred, {r6('avg(n)', 'n_mean')}, {r6('stddev_pop(n)', 'n_sd_pop')} FROM grid GROUP BY y_true, y_pred",
)
add(
    "per_class_prf",
    PREDS,
    confusion("fold"),
    per_class("fold"),
    f"SELECT fold, {i64('label')}, tp, support, predicted, {r6('precision')}, {r6('recall')}, {r6('f1')} FROM prf",
)
add(
    "weighted_macro_metrics",
    PREDS,
    confusion("fold"),
    per_class("fold"),
    metrics("fold"),
    f"SELECT fold, {SIX} FROM metrics",
)
add(
    "balanced_accuracy",
    PREDS,
    confusion("fold, modality"),
    per_class("fold, modality"),
    metrics("fold, modality"),
    f"SELECT fold, modality, {r6('accuracy')}, {r6('balanced_accuracy')} FROM metrics",
)
add(
    "result_rows",
    PREDS,
    confusion("fold"),
    per_class("fold"),
    metrics("fold"),
    "SELECT 'run_protein+rna_hid4-8_ep250_static_mw3-1_cls1_feat1_mod1_bs1024_lr0.0001_seed42_73117659ee90' AS model, "
    f"fold, {SIX} FROM metrics",
)
add(
    "metrics_mean_std",
    PREDS,
    confusion("modality, fold"),
    per_class("modality, fold"),
    metrics("modality, fold"),
    f"SELECT modality, count(*) AS n_folds, {MEAN_STD} FROM metrics GROUP BY modality",
)
add(
    "best_epoch",
    PREDS,
    confusion("fold, epoch"),
    per_class("fold, epoch"),
    metrics("fold, epoch"),
    "ordered AS (SELECT fold, epoch, round(f1_macro, 1) AS f1_macro, row_number() OVER (PARTITION BY fold "
    "ORDER BY round(f1_macro, 1) DESC, epoch) AS rn FROM metrics WHERE epoch % 10 = 0 AND f1_macro > 0)",
    f"SELECT fold, {i64('epoch')}, {r6('f1_macro')} FROM ordered WHERE rn = 1",
)
add(
    "epoch_loss",
    PREDS,
    LOGITS,
    f"l AS (SELECT fold, cell_id, {LSE.format(z='z')} - z[y_true + 1] AS loss, unnest(range(1, 3)) AS epoch FROM logits)",
    f"b AS (SELECT fold, epoch, {BATCH} 8 AS batch, avg(loss) AS loss FROM l GROUP BY ALL)",
    f"SELECT fold, epoch, {r6('sum(loss)', 'loss_sum')}, {r6('avg(loss)', 'loss_mean')} FROM b GROUP BY fold, epoch",
)

# --- models -------------------------------------------------------------------------------

# The static model of ``linear_weights`` has one view, so its output layer is number 4.
LINEAR = f"out AS (SELECT cell_id, {affine('r', 64, 4, 4)} AS o FROM rna)"
for _name in ("linear_layer", "linear_layer_join"):
    add(_name, RNA, LINEAR, f"SELECT cell_id, {elements('o', 4, 'out')} FROM out")


def fusion(gated: bool = True, confident: bool = True, dynamic: bool = True) -> str:
    """Forward pass of the two-view model, one table per stage."""
    stages, last = [], "pair"

    def stage(name: str, **cols: str) -> None:
        nonlocal last
        body = ", ".join(f"{e} AS {c}" for c, e in cols.items())
        stages.append(f"{name} AS MATERIALIZED (SELECT *, {body} FROM {last})")
        last = name

    if dynamic:
        stage(
            "gate",
            gp=f"[1 / (1 + exp(-e)) for e in {affine('p', 6, 6, 0)}]",
            gr=f"[1 / (1 + exp(-e)) for e in {affine('r', 64, 64, 4)}]",
        )
    if gated and dynamic:
        stage("gated", up="[p[i] * gp[i] for i in range(1, 7)]", ur="[r[i] * gr[i] for i in range(1, 65)]")
    else:
        stage("gated", up="p", ur="r")
    stage(
        "hidden",
        hp=f"[greatest(e, 0) for e in {affine('up', 6, 4, 1)}]",
        hr=f"[greatest(e, 0) for e in {affine('ur', 64, 8, 5)}]",
    )
    if dynamic:
        stage(
            "conf",
            tp=affine("hp", 4, 4, 2),
            tr=affine("hr", 8, 4, 6),
            cp=f"({affine('hp', 4, 1, 3)})[1]",
            cr=f"({affine('hr', 8, 1, 7)})[1]",
        )
    factors = ("cp", "cr") if dynamic and confident else ("1", "1") if dynamic else ("3", "1")
    stage("fused", f=f"list_concat([e * {factors[0]} for e in hp], [e * {factors[1]} for e in hr])")
    stage("scored", z=affine("f", 12, 4, 8))
    return ", ".join(stages)


BASE = [META, PROTEIN, RNA, PAIR]
LOGIT_ROWS = (
    f"SELECT cell_id, {i64('y')}, {elements('z', 4, 'z')}, "
    "CAST(list_position(z, list_max(z)) - 1 AS BIGINT) AS y_pred FROM scored"
)
add("static_fusion_logits", *BASE, fusion(dynamic=False), LOGIT_ROWS)
add("dynamic_fusion_logits", *BASE, fusion(), LOGIT_ROWS)
add(
    "masked_modality_logits",
    META,
    PROTEIN,
    RNA,
    PAIR.replace("pair AS", "whole AS"),
    "pair AS (SELECT * EXCLUDE (r), [CAST(0.5 AS DOUBLE) for i in range(64)] AS r FROM whole)",
    fusion(dynamic=False),
    LOGIT_ROWS,
)
add("wide_fusion_logits", *BASE, fusion(), f"SELECT cell_id, {elements('z', 4, 'z')} FROM scored")
add("ungated_fusion_logits", *BASE, fusion(False, False), f"SELECT cell_id, {elements('z', 4, 'z')} FROM scored")
add("fusion_embedding", *BASE, fusion(), indexed("cell_id", "scored", "f", "value", 12))
add(
    "missing_modality_logits",
    META,
    PROTEIN,
    RNA,
    "pair AS (SELECT m.*, p, r IS NOT NULL AS has_rna, coalesce(r, [CAST(0 AS DOUBLE) for i in range(64)]) AS r "
    "FROM meta m JOIN protein USING (cell_id) LEFT JOIN rna USING (cell_id))",
    fusion(dynamic=False).replace("[e * 1 for e in hr]", "[CASE WHEN has_rna THEN e ELSE 0 END for e in hr]"),
    f"SELECT cell_id, has_rna, {elements('z', 4, 'z')} FROM scored",
)
GATES = (
    "gates AS (SELECT cell_id, fold, 'protein' AS modality, gp AS g FROM scored "
    "UNION ALL SELECT cell_id, fold, 'rna', gr FROM scored)"
)
add("fusion_gates", *BASE, fusion(), GATES, indexed("cell_id, modality", "gates", "g", "gate", "len"))
TRUE_P = "exp({t}[y + 1] - list_max({t})) / list_sum([exp(u - list_max({t})) for u in {t}])"
TCP = (
    f"tcp AS (SELECT cell_id, fold, 'protein' AS modality, {TRUE_P.format(t='tp')} AS tcp_true, cp AS tcp_pred "
    f"FROM scored UNION ALL SELECT cell_id, fold, 'rna', {TRUE_P.format(t='tr')}, cr FROM scored)"
)
add(
    "tcp_pairs",
    *BASE,
    fusion(),
    TCP,
    f"SELECT cell_id, fold, modality, {r6('tcp_true')}, {r6('tcp_pred')} FROM tcp",
)


def ce(z: str) -> str:
    return f"weight * ({LSE.format(z=z)} - {z}[s.y + 1])"


add(
    "fusion_loss",
    *BASE,
    SPLIT,
    WEIGHTS.format(k=4),
    fusion(),
    "parts AS (SELECT s.fold, count(*) AS n, "
    f"avg({ce('z')}) AS ce, avg(list_avg(gp)) AS gp, avg(list_avg(gr)) AS gr, "
    f"avg((cp - {TRUE_P.format(t='tp').replace('y + 1', 's.y + 1')}) ** 2 + {ce('tp')}) AS kp, "
    f"avg((cr - {TRUE_P.format(t='tr').replace('y + 1', 's.y + 1')}) ** 2 + {ce('tr')}) AS kr "
    "FROM scored s JOIN weights w ON w.fold = s.fold AND w.y = s.y GROUP BY s.fold)",
    "SELECT fold, n, round(1.3 * (1.3 * CAST(ce AS DOUBLE) + 0.7 * gp + 0.9 * kp) + 0.7 * gr + 0.9 * kr, 6) AS loss FROM parts",
)
add(
    "weighted_ce",
    PREDS,
    LOGITS,
    f"l AS (SELECT fold, (CAST(0.5 AS DOUBLE) + 0.25 * y_true) * ({LSE.format(z='z')} - z[y_true + 1]) AS l FROM logits)",
    f"SELECT fold, count(*) AS n, {r6('avg(l)', 'loss')} FROM l GROUP BY fold",
)
add(
    "confidence_mse",
    PREDS,
    f"SELECT fold, modality, {r6('avg((tcp_pred - tcp_true) ** 2)', 'mse')} FROM preds GROUP BY fold, modality",
)
add(
    "gate_penalty",
    *BASE,
    fusion(),
    GATES,
    f"SELECT fold, modality, {r6('sum(list_sum(g)) / sum(len(g))', 'gate_mean')} FROM gates GROUP BY fold, modality",
)
add(
    "gradient_step",
    META,
    PROTEIN,
    f"z AS (SELECT donor, y, p, {affine('p', 6, 4, 4)} AS z FROM meta JOIN protein USING (cell_id))",
    f"q AS (SELECT *, {SOFTMAX.format(z='z')} AS q FROM z)",
    "long AS (SELECT donor, y, p, q, i, unnest(range(4)) AS j FROM (SELECT *, unnest(range(6)) AS i FROM q))",
    "SELECT donor AS fold, i, j, round(avg(p[i + 1] * (q[j + 1] - CASE WHEN y = j THEN 1 ELSE 0 END)), 6) + 0.0 "
    "AS gradient FROM long GROUP BY donor, i, j",
)


def knn(source: str, vec: str) -> str:
    """Distances to all cells of other donors, five nearest, majority."""
    return (
        f"near AS (SELECT a.donor AS fold, a.cell_id, a.y AS y_true, b.cell_id AS train_id, b.y, "
        f"round(list_distance(a.{vec}, b.{vec}), 9) AS distance, row_number() OVER (PARTITION BY a.cell_id "
        f"ORDER BY round(list_distance(a.{vec}, b.{vec}), 9), b.cell_id) AS rank "
        f"FROM {source} a JOIN {source} b ON a.donor <> b.donor QUALIFY rank <= 5), "
        "votes AS (SELECT fold, cell_id, any_value(y_true) AS y_true, y, count(*) AS n FROM near "
        "GROUP BY fold, cell_id, y), "
        "preds AS (SELECT fold, cell_id, y_true, y AS y_pred FROM votes "
        "QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, y) = 1)"
    )


RNA_CELLS = "cells AS (SELECT m.*, r AS v FROM meta m JOIN rna USING (cell_id))"
PROTEIN_CELLS = "cells AS (SELECT m.*, p AS v FROM meta m JOIN protein USING (cell_id))"
BOTH_CELLS = (
    "cells AS (SELECT m.*, list_concat(p, r) AS v FROM meta m JOIN protein USING (cell_id) JOIN rna USING (cell_id))"
)
for name in ("knn_neighbours", "knn_neighbours_indexed"):
    add(
        name,
        META,
        RNA,
        RNA_CELLS,
        knn("cells", "v"),
        f"SELECT fold, cell_id, rank, train_id, {i64('y')}, {r6('distance')} FROM near",
    )
add(
    "knn_predict",
    META,
    RNA,
    RNA_CELLS,
    knn("cells", "v"),
    f"SELECT fold, cell_id, {i64('y_true')}, {i64('y_pred')} FROM preds",
)
EVALUATED = [confusion("fold"), per_class("fold"), metrics("fold")]
add(
    "lodo_knn_eval",
    META,
    PROTEIN,
    PROTEIN_CELLS,
    knn("cells", "v"),
    *EVALUATED,
    f"SELECT 'KNN' AS model, count(*) AS n_folds, {MEAN_STD} FROM metrics",
)


def ablation_part(name: str, cells: str) -> str:
    inner = ", ".join([cells, knn("cells", "v"), *EVALUATED])
    return f"SELECT * FROM (WITH {inner} SELECT '{name}' AS modalities, 'KNN' AS model, fold, {SIX} FROM metrics)"


add(
    "modality_ablation_knn",
    META,
    PROTEIN,
    RNA,
    " UNION ALL ".join(
        ablation_part(n, c) for n, c in (("protein", PROTEIN_CELLS), ("rna", RNA_CELLS), ("both", BOTH_CELLS))
    ),
)



def layer_gradient(layer: str, inputs: str, outputs: str, n_in: int, n_out: int, number: int) -> str:
    """Mean of delta_j * input_i over the train rows, and the weight after one Adam step."""
    weight = f"sin(7 * i + 13 * j + {number}) / 8"
    return (
        f"SELECT fold, '{layer}' AS layer, i, j, round(g, 6) + 0.0 AS gradient, "
        f"round({weight} - 0.01 * g / (abs(g) + 1e-8), 6) + 0.0 AS updated FROM "
        f"(SELECT fold, i, j, avg({inputs}[i + 1] * {outputs}[j + 1]) AS g FROM (SELECT *, unnest(range({n_out})) AS j "
        f"FROM (SELECT *, unnest(range({n_in})) AS i FROM hidden_delta)) GROUP BY fold, i, j)"
    )


BACK = "[list_inner_product(d, [sin(7 * h + 13 * k + 8) / 8 for k in range(4)]) for h in range({a}, {b})]"
add(
    "training_gradient",
    *BASE,
    SPLIT,
    WEIGHTS.format(k=4),
    fusion(dynamic=False),
    f"soft AS (SELECT s.fold, s.y, weight, c.p, c.r, c.hp, c.hr, c.f, {SOFTMAX.format(z='z')} AS q FROM split s "
    "JOIN scored c USING (cell_id) JOIN weights w ON w.fold = s.fold AND w.y = s.y WHERE s.split = 'train')",
    "delta AS (SELECT *, [weight * (q[k + 1] - CASE WHEN y = k THEN 1 ELSE 0 END) for k in range(4)] AS d FROM soft)",
    f"back AS (SELECT *, {BACK.format(a=0, b=4)} AS bp, {BACK.format(a=4, b=12)} AS br FROM delta)",
    "hidden_delta AS (SELECT *, [CASE WHEN hp[k] > 0 THEN 3 * bp[k] ELSE 0 END for k in range(1, 5)] AS dp, "
    "[CASE WHEN hr[k] > 0 THEN br[k] ELSE 0 END for k in range(1, 9)] AS dr FROM back)",
    " UNION ALL ".join(
        [
            layer_gradient("out.w", "f", "d", 12, 4, 8),
            layer_gradient("protein.enc.w", "p", "dp", 6, 4, 1),
            layer_gradient("rna.enc.w", "r", "dr", 64, 8, 5),
        ]
    ),
)

# --- explanation --------------------------------------------------------------------------

MEANS = (
    "means AS (SELECT fold, modality, k AS idx, avg(g[k + 1]) AS importance "
    "FROM (SELECT *, unnest(range(len(g))) AS k FROM gates) GROUP BY ALL)"
)
add(
    "feature_importance_mean",
    *BASE,
    fusion(),
    GATES,
    MEANS,
    f"SELECT fold, modality, {i64('idx')}, {r6('importance')} FROM means",
)
for _name, _order in (("top10_features", "DESC"), ("bottom10_features", "ASC")):
    add(
        _name,
        *BASE,
        fusion(),
        GATES,
        MEANS,
        f"ordered AS (SELECT *, row_number() OVER (PARTITION BY fold, modality ORDER BY round(importance, 9) {_order}, idx) "
        "AS rank FROM means)",
        "SELECT fold, modality, rank, CASE modality WHEN 'protein' THEN "
        "['vowel', 'german', 'french', 'spanish', 'space', 'log_length'][idx + 1] ELSE 'dim' || idx END AS name, "
        "round(round(importance, 9), 6) + 0.0 AS importance FROM ordered WHERE rank <= 10",
    )
add(
    "mean_importance_grid",
    *BASE,
    fusion(),
    GATES,
    MEANS,
    f"SELECT fold, {i64('idx // 8', 'y')}, {i64('idx % 8', 'x')}, {r6('importance')} FROM means WHERE modality = 'rna'",
)


def error_columns() -> dict[str, str]:
    err = "abs(tcp_true - tcp_pred)"
    mse = "avg((tcp_true - tcp_pred) ** 2)"
    return {
        "true_mean": "avg(tcp_true)",
        "true_min": "min(tcp_true)",
        "true_max": "max(tcp_true)",
        "true_abs_mean": "avg(abs(tcp_true))",
        "pred_mean": "avg(tcp_pred)",
        "pred_min": "min(tcp_pred)",
        "pred_max": "max(tcp_pred)",
        "mse": mse,
        "rmse": f"sqrt({mse})",
        "mae": f"avg({err})",
        "err_sd_pop": f"stddev_pop({err})",
        "err_max": f"max({err})",
        "err_min": f"min({err})",
        "r2": f"1 - {mse} / nullif(var_pop(tcp_true), 0)",
        "mape": f"avg({err} / greatest(abs(tcp_true), 2.220446049250313e-16))",
    }


def errors(names: list[str], source: str) -> str:
    cols = ", ".join(r6(error_columns()[n], n) for n in names)
    return f"SELECT fold, modality, count(*) AS n, {cols} FROM {source} GROUP BY fold, modality"


add("tcp_error_summary", PREDS, errors(list(error_columns()), "preds"))
SHARES = (
    "shares AS (SELECT fold, modality, step, count(*) AS n, count(*) FILTER (WHERE "
    "round(abs(tcp_true - tcp_pred), 9) > round(tcp_true * (step / CAST(10 AS DOUBLE)), 9)) AS n_above, "
    "n_above / n AS share FROM (SELECT *, unnest(range(1, 11)) AS step FROM preds) GROUP BY fold, modality, step)"
)
add(
    "tcp_threshold_shares",
    PREDS,
    SHARES,
    f"SELECT fold, modality, step, n, n_above, {r6('share')} FROM shares",
)
FOUR = f"{r6('avg(share)', 'mean')}, {r6('stddev_pop(share)', 'sd_pop')}, {r6('min(share)', 'min')}, {r6('max(share)', 'max')}"
add("tcp_threshold_summary", PREDS, SHARES, f"SELECT step, {FOUR} FROM shares GROUP BY step")
add(
    "tcp_running_stats",
    PREDS,
    SHARES,
    f"SELECT a.step, a.fold, {FOUR} FROM (SELECT DISTINCT step, fold FROM shares) a JOIN shares b "
    "ON a.step = b.step AND b.fold <= a.fold GROUP BY a.step, a.fold",
)
add(
    "tcp_cumulative_pool",
    PREDS,
    "pool AS (SELECT fold, modality, tcp_true, tcp_pred FROM preds UNION ALL "
    "SELECT fold, 'rna', tcp_true, tcp_pred FROM preds WHERE modality = 'protein')",
    errors(["true_mean", "mse", "mae", "r2"], "pool"),
)
add(
    "fusion_calibration",
    *BASE,
    fusion(),
    TCP,
    errors(["true_mean", "pred_mean", "mse", "mae", "err_sd_pop"], "tcp"),
)

# --- raster -------------------------------------------------------------------------------


def pooled(source: str, k: int, agg: str = "max") -> str:
    return f"SELECT img, y // {k} AS y, x // {k} AS x, c, {agg}(v) AS v FROM {source} GROUP BY img, y // {k}, x // {k}, c"


PIXEL_ROW = f"img, {i64('y')}, {i64('x')}, {i64('c')}, {r6('v')}"
add("block_max_pool", PIXELS, f"pooled AS ({pooled('pixels', 4)})", f"SELECT {PIXEL_ROW} FROM pooled")
add(
    "nearest_upsample",
    PIXELS,
    f"pooled AS ({pooled('pixels', 2)})",
    "up AS (SELECT img, b AS y, a AS x, c, v FROM pooled, range(6) AS ra(a), range(6) AS rb(b) "
    "WHERE (b * 4) // 6 = y AND (a * 4) // 6 = x)",
    f"SELECT {PIXEL_ROW} FROM up",
)
for name in ("focal_sum", "focal_sum_in_tiles", "focal_sum_rows"):
    add(
        name,
        PIXELS,
        "kernel AS (SELECT a - 1 AS dy, b - 1 AS dx, (a + 1) * CAST(0.25 AS DOUBLE) + (b - 1) * 0.125 AS w "
        "FROM range(3) AS ra(a), range(3) AS rb(b))",
        "sums AS (SELECT o.img, o.y, o.x, o.c, sum(i.v * w) AS v FROM pixels o, kernel JOIN pixels i "
        "ON i.img = o.img AND i.y = o.y + dy AND i.x = o.x + dx GROUP BY o.img, o.y, o.x, o.c)",
        f"SELECT {PIXEL_ROW} FROM sums",
    )
add(
    "focal_stride2",
    PIXELS,
    "kernel AS (SELECT a AS dy, b AS dx, k AS co, CAST(0.5 AS DOUBLE) - 0.25 * a + 0.125 * b + k AS w "
    "FROM range(2) AS ra(a), range(2) AS rb(b), range(2) AS rk(k))",
    "sums AS (SELECT img, (y - dy) // 2 AS y, (x - dx) // 2 AS x, co AS c, sum(v * w) + CASE WHEN co = 0 THEN 0.5 "
    "ELSE -0.5 END AS v FROM pixels, kernel WHERE (y - dy) % 2 = 0 AND (x - dx) % 2 = 0 AND y >= dy AND x >= dx "
    "GROUP BY img, (y - dy) // 2, (x - dx) // 2, co)",
    f"SELECT {PIXEL_ROW} FROM sums",
)
add(
    "focal_off_centre",
    PIXELS,
    "places AS (SELECT DISTINCT img, CAST(a AS BIGINT) AS y, CAST(b AS BIGINT) AS x "
    "FROM pixels, range(8) AS ra(a), range(8) AS rb(b))",
    "sums AS (SELECT o.img, o.y, o.x, 0 AS c, coalesce(p.v * 0.5, 0) + 0.25 AS v FROM places o LEFT JOIN pixels p "
    "ON p.img = o.img AND p.y = o.y + 5 AND p.x = o.x + 5 AND p.c = 0)",
    f"SELECT {PIXEL_ROW} FROM sums",
)
add(
    "patch_gate",
    PIXELS,
    "g AS (SELECT *, 1 / (1 + exp(-avg(v) OVER (PARTITION BY img, y // 4, x // 4))) AS gate FROM pixels)",
    f"SELECT img, y, x, c, {r6('gate')}, {r6('v * gate', 'gated')} FROM g",
)
add(
    "patch_gate_channels",
    PIXELS,
    "two AS (SELECT img, y, x, 0 AS c, v FROM pixels UNION ALL SELECT img, y, x, 1, least(v, 0) FROM pixels)",
    "g AS (SELECT *, 1 / (1 + exp(-avg(v) OVER (PARTITION BY img, c, y // 4, x // 4))) AS gate FROM two)",
    f"SELECT img, y, x, {i64('c')}, {r6('gate')}, {r6('v * gate', 'gated')} FROM g",
)
add(
    "flip_pixels",
    PIXELS,
    "bits AS (SELECT *, CAST('0x' || substr(md5('42:1:' || img), 1, 8) AS BIGINT) % 4 AS b FROM pixels)",
    "flipped AS (SELECT img, CASE WHEN b >= 2 THEN 7 - y ELSE y END AS y, CASE WHEN b % 2 = 1 THEN 7 - x ELSE x END "
    "AS x, c, v FROM bits)",
    f"SELECT {PIXEL_ROW} FROM flipped",
)
add(
    "channel_stack",
    PIXELS,
    f"pooled AS ({pooled('pixels', 2)})",
    f"coarse AS ({pooled('pooled', 2)})",
    "both_maps AS (SELECT img, y, x, c, v FROM pooled UNION ALL SELECT img, b, a, c + 1, v FROM coarse, "
    "range(4) AS ra(a), range(4) AS rb(b) WHERE (b * 2) // 4 = y AND (a * 2) // 4 = x)",
    f"SELECT {PIXEL_ROW} FROM both_maps",
)
add(
    "image_vector",
    PIXELS,
    f"pooled AS ({pooled('pixels', 2, 'avg')})",
    f"SELECT img, CAST(y * 4 + x AS BIGINT) AS idx, {r6('v', 'value')} FROM pooled",
)

# --- attention ----------------------------------------------------------------------------

SOFT = (
    "soft AS (SELECT *, exp(score - max(score) OVER w) / sum(exp(score - top)) OVER w AS weight FROM "
    "(SELECT *, max(score) OVER (PARTITION BY {by}) AS top FROM {source}) WINDOW w AS (PARTITION BY {by}))"
)
POOL = ", ".join(r6(f"sum(weight * {v})", v) for v in ("v0", "v1", "v2"))
add(
    "attention_pool",
    TOKENS,
    SOFT.format(by="conv_id", source="tokens"),
    f"SELECT conv_id, {POOL} FROM soft GROUP BY conv_id",
)
add(
    "attention_weights",
    TOKENS,
    SOFT.format(by="conv_id", source="tokens"),
    f"SELECT conv_id, turn, {r6('weight')} FROM soft",
)
SCALED = "scaled AS (SELECT conv_id, turn, v0 / 1000 AS v0, v1, v2 FROM tokens)"
QUERY_ROWS = (
    "latents AS (SELECT * FROM (VALUES (0, 0.5, -0.25, 1.0), (1, -0.5, 0.75, 0.25), (2, 1.0, 1.0, -1.0)) "
    "AS l(latent, q0, q1, q2)), "
    "scores AS (SELECT conv_id, turn, latent, v0, v1, v2, "
    "(CAST(q0 AS DOUBLE) * v0 + CAST(q1 AS DOUBLE) * v1 + CAST(q2 AS DOUBLE) * v2) / sqrt(3) AS score "
    "FROM scaled, latents)"
)
CROSS = [TOKENS, SCALED, QUERY_ROWS, SOFT.format(by="conv_id, latent", source="scores")]
add("cross_attention", *CROSS, f"SELECT conv_id, {i64('latent')}, {POOL} FROM soft GROUP BY conv_id, latent")
add("cross_attention_weights", *CROSS, f"SELECT conv_id, {i64('latent')}, turn, {r6('weight')} FROM soft")
add(
    "latent_mean_pool",
    *CROSS,
    "att AS (SELECT conv_id, latent, sum(weight * v0) AS v0, sum(weight * v1) AS v1, sum(weight * v2) AS v2 "
    "FROM soft GROUP BY conv_id, latent)",
    f"SELECT conv_id, {r6('avg(v0)', 'v0')}, {r6('avg(v1)', 'v1')}, {r6('avg(v2)', 'v2')} FROM att GROUP BY conv_id",
)
add(
    "co_attention",
    TOKENS,
    SCALED,
    "scores AS (SELECT a.conv_id, a.turn, b.v0, b.v1, b.v2, (a.v0 * b.v0 + a.v1 * b.v1 + a.v2 * b.v2) / sqrt(3) AS score "
    "FROM scaled a JOIN scaled b ON a.conv_id = b.conv_id AND a.v2 = 1 AND b.v2 = 0)",
    SOFT.format(by="conv_id, turn", source="scores"),
    "SELECT conv_id, turn, "
    + ", ".join(r6(f"sum(weight * v{i})", f"o{i}") for i in range(3))
    + " FROM soft GROUP BY conv_id, turn",
)
add(
    "outer_product_fusion",
    META,
    PROTEIN,
    TAGS,
    "o AS (SELECT cell_id, [p[k // 2 + 1] * t[k % 2 + 1] for k in range(12)] AS o "
    "FROM meta JOIN protein USING (cell_id) JOIN tags USING (cell_id))",
    indexed("cell_id", "o", "o", "value", 12),
)
CURVE = (
    "hazards AS (SELECT conv_id, turn, 1 / (1 + exp(-(score - 1))) AS hazard FROM tokens), "
    "curve AS (SELECT *, exp(sum(ln(greatest(1 - hazard, 1e-300))) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS UNBOUNDED PRECEDING)) AS survival FROM hazards)"
)
add("survival_curve", TOKENS, CURVE, f"SELECT conv_id, turn, {r6('hazard')}, {r6('survival')} FROM curve")
add("survival_risk", TOKENS, CURVE, f"SELECT conv_id, {r6('-sum(survival)', 'risk')} FROM curve GROUP BY conv_id")

# --- sources and sinks --------------------------------------------------------------------

add("metadata_csv", META, "SELECT cell_id, day, donor, technology, cell_type FROM meta")
add(
    "modality_csv",
    RNA,
    "SELECT cell_id, CAST(k AS BIGINT) AS idx, 'gene' || k AS name, round(r[k + 1], 6) + 0.0 AS value "
    "FROM (SELECT *, unnest(range(64)) AS k FROM rna)",
)
add(
    "modality_csv_reordered",
    RNA,
    "SELECT cell_id, 'gene' || k AS name, round(r[k + 1], 6) + 0.0 AS value "
    "FROM (SELECT *, unnest(range(64)) AS k FROM rna)",
)
add(
    "metrics_csv",
    PREDS,
    confusion("modality, fold"),
    per_class("modality, fold"),
    metrics("modality, fold"),
    "SELECT modality, " + ", ".join(r6(f"avg({m})", f"{m}_mean") for m in METRICS) + " FROM metrics GROUP BY modality",
)
add(
    "confusion_csv",
    PREDS,
    confusion("fold"),
    FOLD_GRID,
    "means AS (SELECT y_true, y_pred, round(avg(n), 6) AS m FROM grid GROUP BY y_true, y_pred)",
    "SELECT "
    + ", ".join(f"max(m) FILTER (WHERE y_pred = {k}) AS pred{k}" for k in range(5))
    + " FROM means GROUP BY y_true",
)
add(
    "metric_log",
    PREDS,
    confusion("fold, epoch"),
    per_class("fold, epoch"),
    metrics("fold, epoch"),
    f"SELECT run_id, fold, epoch, {r6('f1_macro')} FROM metrics, (VALUES ('first'), ('second')) AS t(run_id)",
)
add(
    "image_resize",
    "grey AS (SELECT vec_id, [CAST(abs(floor(CAST(e * CAST(100 AS FLOAT) AS DOUBLE))) AS BIGINT) % 256 for e in embedding] "
    "AS g FROM embeddings)",
    "cells AS (SELECT vec_id, g, unnest(range(48)) AS k FROM grey)",
    "pos AS (SELECT *, ((k % 16) // 4) * 16 + (k % 4) * 2 + 1 AS a FROM cells)",
    "SELECT 'img' || vec_id || '.png' AS file, CAST(k AS BIGINT) AS idx, "
    "round((g[a] + g[a + 1] + g[a + 8] + g[a + 9]) / CAST(1020 AS DOUBLE), 6) + 0.0 AS value FROM pos",
)
add(
    "image_manifest_join",
    META,
    f"SELECT cell_id, {i64('y')}, 'img' || cell_id || '.png' AS file, CAST(64 AS BIGINT) AS n_bytes "
    "FROM meta JOIN embeddings ON vec_id = cell_id",
)
add(
    "image_manifest_rejects",
    META,
    f"SELECT cell_id, {i64('y')}, 'img' || cell_id || '.png' AS file FROM meta "
    "WHERE cell_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)",
)
