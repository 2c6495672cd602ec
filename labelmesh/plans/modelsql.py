"""Checking SQL for the iterative models, unrolled for a fixed number of steps."""

from __future__ import annotations

from labelmesh.plans import sqltext as S
from labelmesh.priors import Priors


def start(k: int) -> str:
    return f"""k AS {S.classes(k)}, j AS (SELECT count(DISTINCT annotator_id) AS j FROM ann),
votes AS (SELECT item_id, label AS truth, sum(n) AS n FROM ann GROUP BY ALL),
g0 AS (
  SELECT item_id, truth, s / sum(s) OVER (PARTITION BY item_id) AS g FROM (
    SELECT i.item_id, k.truth, coalesce(v.n, 0) + j.j * 1e-6::DOUBLE AS s
    FROM items i CROSS JOIN k CROSS JOIN j LEFT JOIN votes v ON v.item_id = i.item_id AND v.truth = k.truth))"""


def softmax(name: str, source: str, score: str, keys: str = "item_id", out: str = "g") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (s, top), exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY {keys}) AS {out} FROM (
  SELECT *, max(s) OVER (PARTITION BY {keys}) AS top FROM (SELECT *, {score} AS s FROM {source})))"""


def m_step(t: int, src: str, k: int, p: Priors) -> str:
    """Class prior and confusion weights from posterior ``src``(item_id, truth, g)."""
    diag, off = p.annotator_cell(k)
    row = diag + (k - 1) * off
    return f"""pi{t} AS (SELECT truth, {p.b_theta} + sum(g) AS pi FROM {src} GROUP BY 1),
pr{t} AS (SELECT truth, {S.digamma('pi')} - {S.digamma('tot')} AS lp FROM (SELECT *, sum(pi) OVER () AS tot FROM pi{t})),
soft{t} AS (SELECT a.annotator_id, a.label, g.truth, sum(a.n * g.g) AS c
  FROM ann a JOIN {src} g ON g.item_id = a.item_id GROUP BY a.annotator_id, a.label, g.truth),
w{t} AS (SELECT annotator_id, label, truth, {S.digamma('v')} - {S.digamma('t')} AS w FROM (
  SELECT *, c + {S.prior_cell(diag, off, 'label', 'truth')} AS v,
         {row!r} + sum(c) OVER (PARTITION BY annotator_id, truth) AS t FROM soft{t}))"""


def word_step(t: int, src: str, k: int, p: Priors) -> str:
    return f"""voc{t} AS (SELECT f.feature, g.truth, sum(f.value * g.g) AS c
  FROM feat f JOIN {src} g ON g.item_id = f.item_id GROUP BY f.feature, g.truth),
vw{t} AS (SELECT feature, truth, {S.digamma('v')} - {S.digamma('t')} AS w FROM (
  SELECT *, c + {p.b_phi} AS v, sum(c + {p.b_phi}) OVER (PARTITION BY truth) AS t FROM voc{t}))"""


def evidence(t: int, words: bool) -> str:
    out = f"""ae{t} AS (SELECT a.item_id, w.truth, sum(a.n * w.w) AS e
  FROM ann a JOIN w{t} w ON w.annotator_id = a.annotator_id AND w.label = a.label GROUP BY a.item_id, w.truth)"""
    if words:
        out += f""",
fe{t} AS (SELECT f.item_id, w.truth, sum(f.value * w.w) AS e
  FROM feat f JOIN vw{t} w ON w.feature = f.feature GROUP BY f.item_id, w.truth)"""
    return out


def variational(k: int, steps: int, words: bool, p: Priors) -> str:
    """g0 .. g<steps>, with m-step tables numbered alike."""
    p = p.with_(c_gamma=1.0)
    parts = [start(k)]
    for t in range(1, steps + 1):
        src = f"g{t - 1}"
        parts.append(m_step(t, src, k, p))
        if words:
            parts.append(word_step(t, src, k, p))
        parts.append(evidence(t, words))
        extra = f"LEFT JOIN fe{t} f ON f.item_id = i.item_id AND f.truth = k.truth" if words else ""
        plus = " + coalesce(f.e, 0)" if words else ""
        parts.append(f"""s{t} AS (SELECT i.item_id, k.truth, pr.lp + coalesce(a.e, 0){plus} AS score
  FROM items i CROSS JOIN k JOIN pr{t} pr ON pr.truth = k.truth
  LEFT JOIN ae{t} a ON a.item_id = i.item_id AND a.truth = k.truth {extra})""")
        parts.append(softmax(f"g{t}", f"s{t}", "score"))
    return ",\n".join(parts)


def simplex(k: int, seed: int) -> str:
    """h0(item_id, truth, g): the hashed uniform-Dirichlet start."""
    return f"""h0 AS (SELECT item_id, truth, e / sum(e) OVER (PARTITION BY item_id) AS g FROM (
  SELECT i.item_id, k.truth, -ln({S.uniform(str(seed), 'i.item_id', 'k.truth')}) AS e FROM items i CROSS JOIN k))"""


def pair_step(t: int, g: str, h: str, og: str, oh: str, k: int, p: Priors) -> str:
    """One iteration of the two-class model: posteriors from ``g``/``h``, parameters from ``og``/``oh``."""
    md, mo = p.machine_cell(k)
    return ",\n".join([
        m_step(t, og, k, p), word_step(t, oh, k, p), evidence(t, True),
        f"""tau{t} AS (SELECT truth, m, {S.digamma('v')} - {S.digamma('tot')} AS w FROM (
  SELECT *, sum(v) OVER (PARTITION BY truth) AS tot FROM (
    SELECT a.truth, b.truth AS m, {S.prior_cell(md, mo, 'a.truth', 'b.truth')} + sum(a.g * b.g) AS v
    FROM {og} a JOIN {oh} b ON b.item_id = a.item_id GROUP BY a.truth, b.truth)))""",
        f"""gs{t} AS (SELECT h.item_id, tau.truth, sum(h.g * tau.w) AS e FROM {h} h JOIN tau{t} tau ON tau.m = h.truth
  GROUP BY h.item_id, tau.truth)""",
        f"""hs{t} AS (SELECT g.item_id, tau.m AS truth, sum(g.g * tau.w) AS e FROM {g} g JOIN tau{t} tau ON tau.truth = g.truth
  GROUP BY g.item_id, tau.m)""",
        f"""sg{t} AS (SELECT x.item_id, x.truth, x.e + pr.lp + coalesce(a.e, 0) AS score FROM gs{t} x
  JOIN pr{t} pr ON pr.truth = x.truth LEFT JOIN ae{t} a ON a.item_id = x.item_id AND a.truth = x.truth)""",
        f"""sh{t} AS (SELECT x.item_id, x.truth, x.e + coalesce(f.e, 0) AS score FROM hs{t} x
  LEFT JOIN fe{t} f ON f.item_id = x.item_id AND f.truth = x.truth)""",
        softmax(f"g{t}", f"sg{t}", "score"), softmax(f"h{t}", f"sh{t}", "score"),
    ])


def ratio(base: str, step: str) -> str:
    return f"(lgamma({base} + {step}) - lgamma({base}))"


def sweep_counts(k: int, p: Priors) -> str:
    """Collapsed counts of the hard state ``st``(item_id, y, m)."""
    diag, off = p.annotator_cell(k)
    row = diag + (k - 1) * off
    return f"""k AS {S.classes(k)},
cc AS (SELECT k.truth, {p.b_theta} + count(st.item_id) AS c FROM k LEFT JOIN st ON st.y = k.truth GROUP BY k.truth),
nn AS (SELECT a.annotator_id, a.label, st.y AS truth, sum(a.n)::DOUBLE AS c
  FROM ann a JOIN st ON st.item_id = a.item_id GROUP BY a.annotator_id, a.label, st.y),
cells AS (SELECT DISTINCT annotator_id, label FROM ann), js AS (SELECT DISTINCT annotator_id FROM ann),
nv AS (SELECT c.annotator_id, c.label, k.truth, {S.prior_cell(diag, off, 'c.label', 'k.truth')} + coalesce(nn.c, 0) AS v
  FROM cells c CROSS JOIN k LEFT JOIN nn ON nn.annotator_id = c.annotator_id AND nn.label = c.label AND nn.truth = k.truth),
nt AS (SELECT js.annotator_id, k.truth, {row!r} + coalesce(sum(nn.c), 0) AS v
  FROM js CROSS JOIN k LEFT JOIN nn ON nn.annotator_id = js.annotator_id AND nn.truth = k.truth
  GROUP BY js.annotator_id, k.truth)"""


def y_conditional() -> str:
    """ys(item_id, truth, s): class prior and annotation parts, own contribution removed."""
    own = "CASE WHEN st.y = nv.truth THEN x.n ELSE 0 END"
    return f"""ya AS (SELECT x.item_id, nv.truth, sum({ratio(f'(nv.v - {own})', 'x.n')}) AS e
  FROM ann x JOIN st ON st.item_id = x.item_id JOIN nv ON nv.annotator_id = x.annotator_id AND nv.label = x.label
  GROUP BY x.item_id, nv.truth),
pairs AS (SELECT item_id, annotator_id, sum(n) AS n FROM ann GROUP BY item_id, annotator_id),
yt AS (SELECT x.item_id, nv.truth, sum({ratio(f'(nv.v - {own})', 'x.n')}) AS e
  FROM pairs x JOIN st ON st.item_id = x.item_id JOIN nt nv ON nv.annotator_id = x.annotator_id GROUP BY x.item_id, nv.truth),
ys AS (SELECT st.item_id, cc.truth, ln(cc.c - (st.y = cc.truth)::INT) + coalesce(ya.e, 0) - coalesce(yt.e, 0) AS s
  FROM st CROSS JOIN cc LEFT JOIN ya ON ya.item_id = st.item_id AND ya.truth = cc.truth
  LEFT JOIN yt ON yt.item_id = st.item_id AND yt.truth = cc.truth)"""


def m_conditional(column: str, p: Priors) -> str:
    """ms(item_id, truth, s): word part for the class in ``column``."""
    own = f"CASE WHEN st.{column} = v.truth THEN f.value ELSE 0 END"
    return f"""fv AS (SELECT w.feature, k.truth, {p.b_phi} + coalesce(c.c, 0) AS v
  FROM (SELECT DISTINCT feature FROM feat) w CROSS JOIN k LEFT JOIN (
    SELECT f.feature, st.{column} AS truth, sum(f.value) AS c FROM feat f JOIN st ON st.item_id = f.item_id
    GROUP BY f.feature, st.{column}) c ON c.feature = w.feature AND c.truth = k.truth),
ft AS (SELECT truth, sum(v) AS v FROM fv GROUP BY truth),
sz AS (SELECT item_id, sum(value) AS value FROM feat GROUP BY item_id),
ma AS (SELECT f.item_id, v.truth, sum({ratio(f'(v.v - {own})', 'f.value')}) AS e
  FROM feat f JOIN st ON st.item_id = f.item_id JOIN fv v ON v.feature = f.feature GROUP BY f.item_id, v.truth),
ms AS (SELECT st.item_id, v.truth, coalesce(ma.e, 0) - CASE WHEN f.value IS NULL THEN 0 ELSE {ratio(f'(v.v - {own})', 'f.value')} END AS s
  FROM st CROSS JOIN ft v LEFT JOIN sz f ON f.item_id = st.item_id
  LEFT JOIN ma ON ma.item_id = st.item_id AND ma.truth = v.truth)"""


def ym_conditional(k: int, p: Priors) -> str:
    md, mo = p.machine_cell(k)
    return f"""mu AS (SELECT a.truth, b.truth AS m, {S.prior_cell(md, mo, 'a.truth', 'b.truth')} + count(st.item_id) AS v
  FROM k a CROSS JOIN k b LEFT JOIN st ON st.y = a.truth AND st.m = b.truth GROUP BY a.truth, b.truth),
mr AS (SELECT truth, sum(v) AS v FROM mu GROUP BY truth),
block AS (SELECT ys.item_id, ys.truth AS y, ms.truth AS m,
    ys.s + ms.s + ln(mu.v - (st.y = mu.truth AND st.m = mu.m)::INT) - ln(mr.v - (st.y = mr.truth)::INT) AS s
  FROM ys JOIN ms ON ms.item_id = ys.item_id JOIN mu ON mu.truth = ys.truth AND mu.m = ms.truth
  JOIN mr ON mr.truth = ys.truth JOIN st ON st.item_id = ys.item_id)"""


def gumbel(seed: str, *keys: str) -> str:
    return f"(-ln(-ln({S.uniform(seed, *keys)})))"


def confusion_grid(k: int, p: Priors) -> str:
    """full_nv(annotator_id, truth, label, v): prior and counts on the full grid, from ``sweep_counts``."""
    cell = S.prior_cell(*p.annotator_cell(k), "t.truth", "l.truth")
    return f"""full_nv AS (SELECT js.annotator_id, t.truth, l.truth AS label, {cell} + coalesce(nn.c, 0) AS v
  FROM js CROSS JOIN k t CROSS JOIN k l LEFT JOIN nn ON nn.annotator_id = js.annotator_id AND nn.truth = t.truth AND nn.label = l.truth)"""


def beta_rows(source: str, value: str, *keys: str) -> str:
    """Sum over the rows of a table of ln B."""
    return f"(SELECT sum(b) FROM (SELECT sum(lgamma({value})) - lgamma(sum({value})) AS b FROM {source} GROUP BY {', '.join(keys)}))"


def fixed_point(name: str, cells: str, totals: str, size: str, start: float, steps: int = 25) -> str:
    """Fixed-point steps of one symmetric strength, two at a time and then extrapolated (Steffensen). ``cells`` and
    ``totals`` give (v, n): how often a count occurs."""
    def step(a: str) -> str:
        return f"""(1 + {a} * (SELECT sum(n * ({S.digamma(f'(v + {a})')} - {S.digamma(a)})) FROM {cells}))
      / (2 + {size} * (SELECT sum(n * ({S.digamma(f'(v + {size} * {a})')} - {S.digamma(f'({size} * {a})')})) FROM {totals}))"""

    bend = "(ln(c) - 2 * ln(b) + ln(a))"
    jump = f"least(greatest(exp(ln(a) - pow(ln(b) - ln(a), 2) / {bend}), c * exp(-2)), c * exp(2))"
    return f"""{name} AS (SELECT 0 AS i, {start}::DOUBLE AS a UNION ALL
  SELECT i + 1, CASE WHEN abs({bend}) < 1e-14 THEN c ELSE {jump} END
  FROM (SELECT i, a, b, {step('b')} AS c FROM (SELECT i, a, {step('a')} AS b FROM {name} WHERE i < {steps})))"""


def fixed_pair(name: str, cells: str, k: int, diag: float, off: float, steps: int = 6000) -> str:
    """The same for the shared (diagonal, off-diagonal) strengths of ``cells`` (annotator_id, truth, label, c), by plain steps."""
    whole = f"(d + {k - 1} * o)"
    down = f"(SELECT sum({S.digamma(f'(v + {whole})')} - {S.digamma(whole)}) FROM {name}_rows)"
    gain = lambda a, kind: f"(SELECT sum(n * ({S.digamma(f'(v + {a})')} - {S.digamma(a)})) FROM {name}_cells WHERE own = {kind})"
    return f"""{name}_rows AS (SELECT sum(c) AS v FROM {cells} GROUP BY annotator_id, truth),
{name}_cells AS (SELECT c AS v, truth = label AS own, count(*) AS n FROM {cells} WHERE c > 0 GROUP BY ALL),
{name} AS (SELECT 0 AS i, {diag!r}::DOUBLE AS d, {off!r}::DOUBLE AS o UNION ALL
  SELECT i + 1, (1 + d * gain_d) / (2 + down), (1 + o * gain_o) / (2 + {k - 1} * down)
  FROM (SELECT *, {gain('d', 'true')} AS gain_d, {gain('o', 'false')} AS gain_o, {down} AS down FROM {name} WHERE i < {steps}))"""
