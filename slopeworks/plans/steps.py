"""Update rules of the trainers on a small quadratic problem (K1-K24, K27), one shared loop with stop rules.

The table-sized work is done before: a rule sees only the (d+1)-sized statistic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from slopeworks.functions.constants import SUBGRADIENT_STEPS
from slopeworks.operators.losses import Quadratic

MAX_TRIALS = 50
CLIP = 10.0  # Nesterov gradients longer than this are shortened to it
NEWTON_RIDGE = 1e-8
SKIP = 1e-8

Update = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, float]]


def schedule(kind: str, lr: float, t: int, decay: float = 0.95, steps: float = 100.0, total: int = 10_000) -> float:
    """Step size at step t."""
    rates = {
        "constant": lambda: lr,
        "inverse": lambda: lr / (t + 1),
        "inverse_sqrt": lambda: lr / (t + 1) ** 0.5,
        "exponential": lambda: lr * decay ** t,
        "linear": lambda: lr * (1 - min(t / total, 0.99)),
        "staircase": lambda: lr * decay ** (t // steps),
        "smooth_exponential": lambda: lr * decay ** (t / steps),
    }
    if kind not in rates:
        raise ValueError(f"unknown step rule {kind!r}")
    return rates[kind]()


def line_search(q: Quadratic, w, g, d, start: float, c1: float, rho: float, c2: float | None = None) -> tuple[float, int]:
    """Backtracking until Armijo holds, and the strong curvature condition if c2 is given.

    When no trial meets both conditions, the first one that met Armijo is used.
    """
    slope, step, armijo = float(g @ d), start, None
    for trial in range(1, MAX_TRIALS + 1):
        if q.change(w, d, step) <= c1 * step * slope:
            armijo = step if armijo is None else armijo
            if c2 is None or abs(q.gradient(w + step * d) @ d) <= c2 * abs(slope):
                return step, trial
        step *= rho
    return (armijo if armijo is not None else 0.0), MAX_TRIALS  # no step descends: stay


def _soft(w: np.ndarray, by: float) -> np.ndarray:
    out = np.sign(w) * np.maximum(np.abs(w) - by, 0.0)
    out[-1] = w[-1]
    return out


def make_update(q: Quadratic, s: dict, spent: dict) -> Update:
    """The update of one method as a function of (weights, gradient, step number)."""
    method, lr, mu = s["method"], s["learning_rate"], s["momentum"]
    p = len(q.b)
    mem: dict = {"v": np.zeros(p), "m": np.zeros(p), "s2": np.zeros(p), "inv": np.eye(p), "pairs": [], "last": None}

    def rate(t: int) -> float:
        return schedule(s["step"], lr, t, s["decay"], s["decay_steps"], s["max_iter"])

    def search(w, g, d, start, c2=None):
        step, trials = line_search(q, w, g, d, start, s["c1"], s["rho"], c2)
        spent["loss"] += trials + 1
        return step

    def along(w, g, d, t):
        """Step along d by the setup's rule."""
        if s["step"] in ("backtracking", "wolfe"):
            step = search(w, g, d, lr, s["c2"] if s["step"] == "wolfe" else None)
        else:
            step = rate(t)
        return w + step * d, step

    def gd(w, g, t):
        return along(w, g, -g, t)

    def momentum(w, g, t):
        mem["v"] = mu * mem["v"] + g
        return w - rate(t) * mem["v"], rate(t)

    def nesterov(w, g, t):
        ahead = q.gradient(w - rate(t) * mu * mem["v"])
        spent["gradient"] += 1
        norm = np.linalg.norm(ahead)
        mem["v"] = mu * mem["v"] + (ahead * (CLIP / norm) if norm > CLIP else ahead)
        return w - rate(t) * mem["v"], rate(t)

    def adam(w, g, t):
        b1, b2 = 0.9, 0.999
        mem["m"], mem["s2"] = b1 * mem["m"] + (1 - b1) * g, b2 * mem["s2"] + (1 - b2) * g * g
        m, v = mem["m"] / (1 - b1 ** (t + 1)), mem["s2"] / (1 - b2 ** (t + 1))
        return w - rate(t) * m / (np.sqrt(v) + 1e-8), rate(t)

    def newton(w, g, t):
        d = -np.linalg.solve(q.hessian(w) + NEWTON_RIDGE * np.eye(p), g)
        spent["hessian"] += 1
        return (w + d, 1.0) if method == "newton" else along(w, g, d, t)

    def curvature_pair(w, g):
        """(s, y) of the last step, or None at the first."""
        last, mem["last"] = mem["last"], (w, g)
        return None if last is None else (w - last[0], g - last[1])

    def damped(sv, y):
        """Powell damping: keeps s'y >= 0.2 s'Bs with B the inverse of the current inverse approximation."""
        bs = np.linalg.solve(mem["inv"], sv)
        sbs, sy = float(sv @ bs), float(sv @ y)
        if sy >= 0.2 * sbs:
            return y
        theta = 0.8 * sbs / (sbs - sy)
        return theta * y + (1 - theta) * bs

    def bfgs(w, g, t):
        pair = curvature_pair(w, g)
        if pair is not None and np.linalg.norm(pair[0]) > 1e-14:
            sv, y = pair
            y = damped(sv, y)
            sy = float(sv @ y)
            if sy > 1e-14:
                left = np.eye(p) - np.outer(sv, y) / sy
                mem["inv"] = left @ mem["inv"] @ left.T + np.outer(sv, sv) / sy
        d = -mem["inv"] @ g
        if g @ d >= 0:
            mem["inv"], d = np.eye(p), -g
        step = search(w, g, d, 1.0, s["c2"])
        return w + step * d, step

    def lbfgs(w, g, t):
        pair = curvature_pair(w, g)
        if pair is not None and pair[0] @ pair[1] > 1e-14:
            mem["pairs"] = (mem["pairs"] + [pair])[-s["memory"]:]
        d = lbfgs_direction(g, mem["pairs"])
        if g @ d >= 0:
            mem["pairs"], d = [], -g
        step = search(w, g, d, 1.0, s["c2"])
        return w + step * d, step

    def sr1(w, g, t):
        pair = curvature_pair(w, g)
        if pair is not None:
            gap = pair[0] - mem["inv"] @ pair[1]
            den = float(gap @ pair[1])
            if abs(den) > SKIP * np.linalg.norm(pair[1]) * np.linalg.norm(gap):
                mem["inv"] = mem["inv"] + np.outer(gap, gap) / den
            else:
                spent["skipped"] += 1
        d = -mem["inv"] @ g
        if g @ d >= 0:
            d = -g
        step = search(w, g, d, 1.0)
        return w + step * d, step

    def cg(w, g, t):
        last, d = mem["last"], -g
        if last is not None:
            beta = max(0.0, float(g @ (g - last[0])) / max(float(last[0] @ last[0]), 1e-300))
            d = -g + beta * last[1]
            d = -g if g @ d >= 0 else d
        curve = float(d @ q.hessian(w) @ d)
        start = -float(g @ d) / curve if curve > 0 else lr
        mem["last"] = (g, d)
        step = search(w, g, d, start)
        return w + step * d, step

    def newton_cg(w, g, t):
        h, d, r = q.hessian(w), np.zeros(p), -g
        direction, rr = r.copy(), float(g @ g)
        limit = min(0.5, rr ** 0.25) * rr ** 0.5
        spent["hessian"] += 1
        for _ in range(10 * p):
            if rr ** 0.5 <= limit * 1e-4:
                break
            hd = h @ direction
            a = rr / max(float(direction @ hd), 1e-300)
            d, r = d + a * direction, r - a * hd
            new = float(r @ r)
            direction, rr = r + new / rr * direction, new
        step = search(w, g, d, 1.0)
        return w + step * d, step

    def subgradient(w, g, t):
        base = SUBGRADIENT_STEPS[s["step"]]
        norm = float(np.linalg.norm(g)) or 1.0
        step = {"constant_step": base, "constant_length": base / norm, "square_summable": base / (t + 1),
                "diminishing": base / (t + 1) ** 0.5}[s["step"]]
        return w - step * g, step

    def prox(w, g, t):
        smooth = q.h @ w - q.b
        return _soft(w - rate(t) * smooth, rate(t) * q.lam), rate(t)

    rules = {"gd": gd, "momentum": momentum, "nesterov": nesterov, "adam": adam, "newton": newton, "damped_newton": newton,
             "bfgs": bfgs, "lbfgs": lbfgs, "sr1": sr1, "cg": cg, "newton_cg": newton_cg, "subgradient": subgradient, "prox": prox}
    if method not in rules:
        raise ValueError(f"unknown method {method!r}")
    return rules[method]


def lbfgs_direction(g: np.ndarray, pairs: list) -> np.ndarray:
    """Two-loop recursion with the usual s'y / y'y scaling."""
    r, back = g.copy(), []
    for sv, y in reversed(pairs):
        a = float(sv @ r) / float(sv @ y)
        r = r - a * y
        back.append(a)
    if pairs:
        sv, y = pairs[-1]
        r = r * (float(sv @ y) / float(y @ y))
    for (sv, y), a in zip(pairs, reversed(back)):
        r = r + sv * (a - float(y @ r) / float(sv @ y))
    return -r


def stop_reason(gnorm: float, loss: float, change: float | None, t: int, tolerance: float, max_iter: int,
                w: np.ndarray | None = None) -> tuple[bool, bool, str]:
    """(stopped, converged, reason): numerical trouble, then small gradient with small change, then the limit."""
    for name, v in (("gradient norm", gnorm), ("loss", loss)):
        if np.isnan(v) or np.isinf(v):
            return True, False, f"{'NaN' if np.isnan(v) else 'Inf'} in {name}"
    if w is not None and not np.isfinite(w).all():
        return True, False, "NaN or Inf in weights"
    if t > 0 and change is not None and gnorm < tolerance and abs(change) < tolerance:
        return True, True, "gradient norm and loss change below tolerance"
    return (True, False, "iteration limit") if t >= max_iter else (False, False, "")


# Second-order methods reach the accuracy of the arithmetic in few steps; beyond it they would repeat one point.
STALLING = frozenset(("newton", "damped_newton", "bfgs", "lbfgs", "sr1", "cg", "newton_cg"))
STILL_CHECKS = 5


def minimise(zz: np.ndarray, s: dict) -> dict:
    """Runs one setup. Loss and gradient norm of a history record belong to the same weights."""
    q = Quadratic(zz, s["loss"] if s["method"] != "prox" else "l1", s["regularization"], s["l1_ratio"])
    spent = {"loss": 0, "gradient": 0, "hessian": 0, "skipped": 0}
    by_loss = s["method"] == "subgradient"
    w = np.zeros(len(q.b))
    history, best, last_loss, update = [], None, None, make_update(q, s, spent)
    step, t, still, least = 0.0, 0, 0, np.inf
    with np.errstate(all="ignore"):
        while True:
            g = q.gradient(w)
            spent["gradient"] += 1
            if by_loss or t % s["check_every"] == 0 or t >= s["max_iter"]:
                loss = q.value(w)
                spent["loss"] += 1
                measured = g if s["method"] != "prox" else (w - _soft(w - (q.h @ w - q.b), q.lam))
                gnorm = float(np.linalg.norm(measured))
                better = best is None or ((loss < best[1]) if by_loss else (gnorm < best[2]))
                before = best
                if np.isfinite(loss) and np.isfinite(gnorm) and better:
                    best = (t, loss, gnorm, w.copy())
                if t % s["check_every"] == 0 or t >= s["max_iter"]:
                    history.append((t, loss, gnorm, step, w.tolist() if s["keep_weights"] else None))
                change = None if last_loss is None else loss - last_loss
                stopped, converged, reason = stop_reason(gnorm, loss, change, t, s["tolerance"], s["max_iter"], w)
                if by_loss and not stopped and better and before is not None and abs(before[1] - loss) < s["tolerance"]:
                    stopped, converged, reason = True, True, "minimum loss stopped changing"
                # Rounding: the loss stands still and the gradient norm has stopped falling.
                still = still + 1 if change is not None and abs(change) <= 1e-15 * max(1.0, abs(loss)) and gnorm > 0.5 * least else 0
                least = min(least, gnorm)
                if not stopped and s["method"] in STALLING and still >= STILL_CHECKS:
                    stopped, converged, reason = True, False, "no further progress"
                if stopped:
                    break
                last_loss = loss
            try:
                w, step = update(w, g, t)
            except np.linalg.LinAlgError:
                stopped, converged, reason = True, False, "singular system"
                break
            t += 1
    best = best or (t, loss, gnorm, w)
    n, p = q.n, len(w)
    # Multiplications that were done: the statistic of the table once, then work on the p x p matrix.
    ops = n * (p + 1) ** 2 + (spent["loss"] + spent["gradient"]) * p * p + spent["hessian"] * p ** 3 + t * 2 * p
    return {
        "stopped": True, "converged": converged, "reason": reason, "final_iteration": t, "final_loss": loss,
        "final_gradient_norm": gnorm, "best_iteration": best[0], "best_loss": best[1], "best_gradient_norm": best[2],
        "weights": best[3].tolist(), "last_weights": w.tolist(), "n": n, "n_features": p - 1,
        "function_evaluations": spent["loss"], "gradient_evaluations": spent["gradient"],
        "hessian_evaluations": spent["hessian"], "skipped_updates": spent["skipped"], "total_operations": float(ops),
        "history": history,
    }
