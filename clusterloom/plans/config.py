"""Run configuration: algorithm names, refinement gates and where results go."""

from __future__ import annotations

import re
from dataclasses import dataclass

_NAME = re.compile(r"(?P<leiden>leiden)-(?:mod|cpm-(?P<res>[0-9.]+(?:e-?[0-9]+)?))|(?P<infomap>infomap)|ikc-(?P<k>[0-9]+)|sbm-(?:flat-(?:dc|ndc|pp|best)|nested-(?:dc|ndc|best))")


@dataclass(frozen=True)
class Algorithm:
    name: str
    family: str
    model: str | None = None
    resolution: float | None = None
    k: int | None = None


def parse_algorithm(name: str) -> Algorithm:
    m = _NAME.fullmatch(name)
    if not m:
        raise ValueError(f"unknown algorithm {name!r}")
    family, _, rest = name.partition("-")
    if family == "leiden":
        return Algorithm(name, family, rest.partition("-")[0], float(m["res"]) if m["res"] else None)
    return Algorithm(name, family, rest or None, k=int(m["k"]) if m["k"] else None)


GATES = {"ikc": (), "leiden": ("cm",), "sbm": ("cc", "wcc"), "infomap": ("cc",)}


def allowed_refinements(algorithm: Algorithm, wanted: tuple[str, ...]) -> tuple[str, ...]:
    """Those of cc, wcc and cm that the algorithm's family supports; the others are left out."""
    return tuple(r for r in wanted if r in GATES[algorithm.family])


@dataclass(frozen=True)
class Routes:
    edges: str
    truth: str | None
    root: str
    sub: str

    def output(self, kind: str, algorithm: str, refinement: str = "", criterion: str = "") -> str:
        tag = f"+{refinement}" + (f"({criterion})" if criterion and refinement in ("wcc", "cm") else "") if refinement else ""
        return f"{self.root}/{kind}/{algorithm}{tag}{self.sub}"


def routes(*, edges: str | None = None, out_dir: str | None = None, real: bool = False, synthetic: bool = False, network: str = "", generator: str = "", gt_id: str = "", run_id: str = "", truth: str | None = None) -> Routes:
    """Input and output places in custom, real and synthetic mode."""
    if real and synthetic:
        raise ValueError("real and synthetic exclude each other")
    if real:
        if not network:
            raise ValueError("real mode needs a network")
        return Routes(f"data/empirical_networks/networks/{network}/{network}.csv", truth, "data/reference_clusterings", f"/{network}")
    if synthetic:
        if not (network and generator and gt_id):
            raise ValueError("synthetic mode needs a network, a generator and a ground-truth id")
        run_id = run_id or "0"
        edges = f"data/synthetic_networks/networks/{generator}/{gt_id}/{network}/{run_id}/edge.csv"
        truth = truth or f"data/reference_clusterings/clusterings/{gt_id}/{network}/com.csv"
        out_dir = "data/estimated_clusterings"
    if not edges or not out_dir:
        raise ValueError("custom mode needs an edge list and an output folder")
    part = lambda x: f"/{x}" if x else ""
    return Routes(edges, truth, out_dir + part(generator) + part(gt_id), part(network) + part(run_id))
