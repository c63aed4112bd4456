"""Newton's method for the four-coefficient logit written as SQL, for the oracle statements."""

from __future__ import annotations

X = ("1.0::double", "tc", "tc*tc", "f")
B = ("b0", "b1", "b2", "b3")
UPPER = [(i, j) for i in range(4) for j in range(i, 4)]


def _sym(i: int, j: int) -> str:
    return f"a{min(i, j)}{max(i, j)}"


def solve(source: str, keep: str) -> str:
    """Gaussian elimination of a symmetric 4x4 system held in columns a00..a33, r0..r3.

    Returns a query with the kept columns and the solution d0..d3.
    """
    q = source
    for k in range(3):
        cols = []
        for i, j in UPPER:
            e = f"a{i}{j}"
            if i > k:
                e = f"a{i}{j} - {_sym(k, i)}*{_sym(k, j)}/a{k}{k} as a{i}{j}"
            cols.append(e)
        for i in range(4):
            cols.append(f"r{i} - {_sym(k, i)}*r{k}/a{k}{k} as r{i}" if i > k else f"r{i}")
        q = f"select {keep}, {', '.join(cols)} from ({q})"
    # rows of the eliminated system: sum_j>=i a_ij d_j = r_i
    done = ""
    for i in (3, 2, 1, 0):
        known = "".join(f" - a{i}{j}*d{j}" for j in range(i + 1, 4))
        rest = ", ".join([f"a{p}{s}" for p, s in UPPER] + [f"r{p}" for p in range(4)])
        q = f"select {keep}{done}, {rest}, (r{i}{known})/a{i}{i} as d{i} from ({q})"
        done += f", d{i}"
    return q


def newton(name: str, counts: str, keys: str, steps: int = 10) -> str:
    """CTEs ``name``: coefficients b0..b3 per key from a table of (keys, tc, f, s, n)."""
    on = " and ".join(f"i.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    ik = ", ".join(f"i.{k.strip()}" for k in keys.split(","))
    p = "1.0::double/(1.0::double+exp(-(i.b0+i.b1*c.tc+i.b2*c.tc*c.tc+i.b3*c.f)))"
    cx = [x.replace("tc", "c.tc") if x != "f" else "c.f" for x in X]
    a = ", ".join(f"sum(w*({cx[i]})*({cx[j]})) as a{i}{j}".replace("c.", "") for i, j in UPPER)
    r = ", ".join(f"sum(({cx[i]})*e) as r{i}".replace("c.", "") for i in range(4))
    joined = (
        f"select k, {keys}, b0, b1, b2, b3, tc, f, n*p*(1.0::double-p) as w, s - n*p as e from ("
        f"select i.k, {ik}, i.b0, i.b1, i.b2, i.b3, c.tc, c.f, c.s, c.n, {p} as p "
        f"from {name}_it i join {counts} c on {on} where i.k < {steps})"
    )
    summed = f"select k, {keys}, b0, b1, b2, b3, {a}, {r} from ({joined}) group by k, {keys}, b0, b1, b2, b3"
    step = solve(summed, f"k, {keys}, b0, b1, b2, b3")
    return f"""{name}_it as (
  select 0 as k, {keys}, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2, 0.0::double as b3
  from (select distinct {keys} from {counts})
  union all
  select k + 1, {keys}, b0 + d0, b1 + d1, b2 + d2, b3 + d3 from ({step})),
{name} as (select {keys}, b0, b1, b2, b3 from {name}_it where k = {steps})"""
