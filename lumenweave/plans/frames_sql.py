"""Oracle SQL of the frame queries: the same frames written out in plain SQL."""

from __future__ import annotations

from lumenweave.sources.patterns import CANARY, CHECKER, COLOR_BLOCKS

W, H, N = 48, 32, 4  # the queries' frames


def grid(w: int = W, h: int = H, n: int = N) -> str:
    return f"(SELECT i // ({w} * {h}) AS frame, (i // {w}) % {h} AS y, i % {w} AS x FROM (SELECT range AS i FROM range({w} * {h} * {n})))"


def _case(index: str, choices: tuple, k: int) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {j} THEN {c[k]}" for j, c in enumerate(choices)) + " END"


def pattern(kind: str, w: int = W, h: int = H, n: int = N) -> str:
    v = {
        "black": ["0", "0", "0"],
        "checker": [_case("(x // 8 + y // 8 + frame) % 2", CHECKER, k) for k in range(3)],
        "gradient": ["(x * 7 + y * 5 + frame * 17) % 256", "(64 + x * 3 + frame * 11) % 256", "(96 + y * 4 + frame * 13) % 256"],
        "color_blocks": [_case("(x // 8 + (y // 8) * 2 + frame) % 4", COLOR_BLOCKS, k) for k in range(3)],
    }[kind]
    return f"(SELECT frame, y, x, " + ", ".join(f"CAST({c} AS BIGINT) AS v{k}" for k, c in enumerate(v)) + f" FROM {grid(w, h, n)})"


def canary(depth: int, w: int = W, h: int = H, n: int = N) -> str:
    mask = (1 << (depth - 8)) - 1
    low = lambda p: f"(((x & 3) | ((y & 3) << 2) | {2 * p} | frame) & {mask})"
    base = lambda p: "CASE (x // 8 + (y // 8) * 2 + frame) % 4 " + " ".join(f"WHEN {j} THEN {b}" for j, b in enumerate(CANARY[p])) + " END"
    return "(SELECT frame, y, x, " + ", ".join(f"CAST(({base(p)} << {depth - 8}) | (CASE WHEN {low(p)} = 0 THEN {mask} ELSE {low(p)} END) AS BIGINT) AS v{p}" for p in range(3)) + f" FROM {grid(w, h, n)})"


def disturbed(s: str) -> str:
    """The frames with every third sample off by two."""
    return f"(SELECT frame, y, x, CASE WHEN (x + y) % 3 = 0 THEN least(v0 + 2, 255) ELSE v0 END AS v0, v1, CASE WHEN x % 5 = 0 THEN 255 - v2 ELSE v2 END AS v2 FROM {s})"


def block_sse(s: str, size: int) -> str:
    return f"""(SELECT frame, gy, gx, m AS mean, CAST(sum((v0 - m) * (v0 - m)) AS BIGINT) AS sse FROM (
  SELECT *, (sum(v0) OVER b + count(*) OVER b // 2) // count(*) OVER b AS m FROM (SELECT *, y // {size} AS gy, x // {size} AS gx FROM {s}) WINDOW b AS (PARTITION BY frame, gy, gx)) GROUP BY frame, gy, gx, m)"""


def sse(a: str, b: str) -> str:
    return f"(SELECT frame, count(*) AS n, " + ", ".join(f"CAST(sum((p.v{k} - q.v{k}) * (p.v{k} - q.v{k})) AS BIGINT) AS sse{k}" for k in range(3)) + f" FROM {a} p JOIN {b} q USING (frame, y, x) GROUP BY frame)"


def psnr(of: str) -> str:
    one = lambda e, n: f"CASE WHEN {e} = 0 THEN CAST('inf' AS DOUBLE) ELSE round(10 * log10(65025.0 * {n} / {e}), 6) END"
    return "SELECT frame, " + ", ".join(f"{one(f'sse{k}', 'n')} AS psnr{k}" for k in range(3)) + f", {one('(sse0 + sse1 + sse2)', '(3 * n)')} AS psnr_all FROM {of}"


def _lift(n: list[str]) -> tuple[str, list[str]]:
    a, b, c, d = n
    e = f"((({a} + {b}) - ({d} - {c})) >> 1)"
    p, q = f"({e} - {b})", f"({e} - {c})"
    return "", [f"(({a} + {b}) - {q})", q, f"(({d} - {c}) + {p})", p]


def wht(s: str) -> str:
    """Coefficients of 4 x 4 blocks of v0 - 128 as 16 columns gathered to a list."""
    src = f"(SELECT frame, y // 4 AS gy, x // 4 AS gx, " + ", ".join(f"max(CASE WHEN y % 4 = {j} AND x % 4 = {i} THEN v0 - 128 END) AS s{4 * j + i}" for j in range(4) for i in range(4)) + f" FROM {s} GROUP BY frame, gy, gx)"
    cols: dict[int, str] = {}
    for i in range(4):
        _, out = _lift([f"s{4 * j + i}" for j in range(4)])
        cols |= {4 * j + i: out[j] for j in range(4)}
    mid = "(SELECT frame, gy, gx, " + ", ".join(f"{cols[k]} AS t{k}" for k in range(16)) + f" FROM {src})"
    rows: dict[int, str] = {}
    for j in range(4):
        _, out = _lift([f"t{4 * j + i}" for i in range(4)])
        rows |= {4 * j + i: out[i] for i in range(4)}
    return "SELECT frame, gy, gx, " + ", ".join(f"CAST({rows[k]} * 8 AS BIGINT) AS c{k}" for k in range(16)) + f", TRUE AS exact FROM {mid}"


def dct(s: str, step: int) -> str:
    """Cosine coefficients and levels of 4 x 4 blocks of v0 - 128, and the squared error, a select for each pass."""
    f = ((11585, 11585, 11585, 11585), (15137, 6270, -6270, -15137), (11585, -11585, -11585, 11585), (6270, -15137, 15137, -6270))
    g = ((64, 64, 64, 64), (83, 35, -35, -83), (64, -64, -64, 64), (35, -83, 83, -35))
    cells = [(j, i) for j in range(4) for i in range(4)]
    cut = lambda e, r: f"greatest(-{r}, least({r} - 1, {e}))"
    keep = "SELECT frame, gy, gx, "
    sql = f"(SELECT frame, y // 4 AS gy, x // 4 AS gx, " + ", ".join(f"max(CASE WHEN y % 4 = {j} AND x % 4 = {i} THEN v0 - 128 END) AS s{4 * j + i}" for j, i in cells) + f" FROM {s} GROUP BY frame, y // 4, x // 4)"
    put = lambda j, i: f"(s{4 * j + i} * 16" + (" + CAST(s0 <> 0 AS BIGINT))" if j == i == 0 else ")")
    sql = f"(SELECT *, " + ", ".join(f"({' + '.join(f'{f[k][j]} * {put(j, i)}' for j in range(4))} + 8192) >> 14 AS t{4 * k + i}" for k, i in cells) + f" FROM {sql})"
    sql = "(SELECT *, " + ", ".join(f"((({' + '.join(f'{f[m][i]} * t{4 * k + i}' for i in range(4))} + 8192) >> 14) + 1) >> 2 AS c{4 * k + m}" for k, m in cells) + f" FROM {sql})"
    sql = "(SELECT *, " + ", ".join(f"sign(c{k}) * CASE WHEN abs(c{k}) * 16 >= {step} THEN ((abs(c{k}) + {64 * step // 1024}) * {(1 << 23) // step}) >> 20 ELSE 0 END AS q{k}" for k in range(16)) + f" FROM {sql})"
    back = lambda k: f"(sign(q{k}) * ((abs(q{k}) * {step} + 4) >> 3))"
    sql = "(SELECT *, " + ", ".join(cut(f"(({' + '.join(f'{g[m][i]} * ' + cut(back(4 * k + m), 32768) for m in range(4))} + 64) >> 7)", 32768) + f" AS w{4 * k + i}" for k, i in cells) + f" FROM {sql})"
    sse = " + ".join("pow(" + cut(f"(({' + '.join(f'{g[k][j]} * w{4 * k + i}' for k in range(4))} + 512) >> 10)", 256) + f" - s{4 * j + i}, 2)" for j, i in cells)
    return keep + ", ".join(f"CAST(c{k} AS BIGINT) AS c{k}, CAST(q{k} AS BIGINT) AS q{k}" for k in range(16)) + f", CAST({sse} AS BIGINT) AS sse FROM {sql}"
