"""SQL fragments that several oracle texts share."""

from __future__ import annotations

from tallycast.plans.oracle_views import r

CLIP_SQL = "least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"


def key_list(keys: list[str]) -> str:
    return ", ".join(keys) if keys else "1"


def ranked_sql(source: str, keys: list[str], p: str = "p", y: str = "outcome", w: str = "1", clip: bool = True) -> str:
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    score = CLIP_SQL.format(p=p) if clip else p
    return f"""(SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
        sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
        sum(pos) OVER ({part}) AS tot_pos, sum(neg) OVER ({part}) AS tot_neg
      FROM (SELECT {k}{score} AS score, CAST(sum({w} * {y}) AS DOUBLE) AS pos, CAST(sum({w} * (1 - {y})) AS DOUBLE) AS neg, count(*) AS n_rows
            FROM {source} WHERE {p} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL))"""


AUC_EXPR = "sum(pos * (neg_below + neg / 2.0)) / nullif(max(tot_pos) * max(tot_neg), 0)"
AP_EXPR = "CASE WHEN max(tot_neg) > 0 THEN sum(pos * CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END) / nullif(max(tot_pos), 0) END"
LOSS_EXPR = "sum(-(pos * ln(score) + neg * ln(1 - score))) / nullif(max(tot_pos) + max(tot_neg), 0)"
BRIER_EXPR = "sum(pos * (1 - score) * (1 - score) + neg * score * score) / nullif(max(tot_pos) + max(tot_neg), 0)"


def auc_sql(source: str, keys: list[str], **kw) -> str:
    k = "".join(f"{x}, " for x in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"(SELECT {k}{AUC_EXPR} AS auc FROM {ranked_sql(source, keys, **kw)} {group})"


def metric_sql(source: str, keys: list[str], **kw) -> str:
    k = "".join(f"{x}, " for x in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""(SELECT {k}CAST(sum(n_rows) AS BIGINT) AS n, {AUC_EXPR} AS auc, {AP_EXPR} AS pr_auc, {LOSS_EXPR} AS log_loss, {BRIER_EXPR} AS brier
        FROM {ranked_sql(source, keys, **kw)} {group})"""


def rounded(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in cols)


def slice_sql(source: str, keys: list[str], min_rows: int = 0) -> str:
    on = " AND ".join(f"s.{k} = a.{k}" for k in keys)
    return f"""SELECT {', '.join('s.' + k for k in keys)}, s.n, s.markets, {r('a.auc', 6)} AS auc
        FROM (SELECT {', '.join(keys)}, count(*) AS n, count(DISTINCT market_id) AS markets FROM {source} GROUP BY ALL HAVING count(*) >= {min_rows}) s
        JOIN {auc_sql(source, keys)} a ON {on}"""


def mixed_sql(x: str) -> str:
    y = f"((({x}) * 2146121005) & 2147483647)"
    z = f"((xor({y}, {y} >> 15) * 74229387) & 2147483647)"
    return f"xor({z}, {z} >> 13)"


def draws_sql(groups: str, n_boot: int, seed: int) -> str:
    """Draw table (b, idx) over the numbered groups view: slots of a replicate count for leaves of 1,024 groups, and
    each leaf draws among its own groups as often."""
    return f"""SELECT b, leaf * 1024 + {mixed_sql('xor(k, j)')} % least(1024, n - leaf * 1024) AS idx FROM (
        SELECT b, leaf, n, {mixed_sql('xor(key, leaf + 1)')} AS k, unnest(range(c)) AS j FROM (
          SELECT b, key, n, (high * 2147483648 + low) % n // 1024 AS leaf, count(*) AS c FROM (
            SELECT *, {mixed_sql('(high + key) & 2147483647')} AS low FROM (
              SELECT *, {mixed_sql('xor(key, idx & 2147483647)')} AS high FROM (
                SELECT idx, n_groups AS n, b, {mixed_sql(f'b + {(seed * 7919 + 1) % 2147483647}')} AS key FROM {groups}, (SELECT unnest(range({n_boot})) AS b))))
          GROUP BY ALL))"""


def groups_sql(source: str, group: str) -> str:
    return f"""SELECT {group}, row_number() OVER (ORDER BY md5(CAST({group} AS VARCHAR)), {group}) - 1 AS idx, count(*) OVER () AS n_groups
        FROM (SELECT DISTINCT {group} FROM {source})"""


def case_buckets(col: str, buckets, closed: bool = False) -> str:
    upper = "<=" if closed else "<"
    whens = " ".join(f"WHEN {col} >= {lo!r}::DOUBLE AND {col} {upper} {hi!r}::DOUBLE THEN '{label}'" for label, lo, hi in buckets)
    return f"CASE {whens} END"
