"""Settings files: ``key = value`` lines for a search, and blocks of filters for its labels."""

from __future__ import annotations

import ast
import logging
from dataclasses import dataclass, fields, replace

from nearfield.functions.filters import Divide, Filter, Interval, IntervalMap, Shift
from nearfield.plans.indexes import Params

log = logging.getLogger(__name__)

#: Setting names and the parameters that they set.
_PARAMS = {
    "topk": "k", "pq_dim": "parts", "n_clusters": "codes", "exps0": "keep", "exps1": "keep_soft", "merge_rate": "penalty",
    "clusters0": "label_clusters", "clusters1": "lists", "max_grids_cnt": "max_cells", "max_grids": "grids", "n_list": "probes",
    "clusters": "clusters", "sub_clusters": "sub_clusters", "sub_lists": "sub_probes", "label_mask": "label_mask", "degree": "degree",
    "i_degree": "i_degree", "itopk_size": "frontier", "search_width": "width", "beta": "beta", "refine": "refine", "n_probes": "probes",
}
#: Names that mean something else to one strategy.
_OWN = {"ivfpq-post": {"n_list": "lists", "pq_bits": "codes", "kmeans_n_iters": "iterations"}}


@dataclass(frozen=True)
class Settings:
    path: str = ""
    filter_dim: int = 1
    params: Params = Params()


def parse_settings(text: str, algorithm: str = "") -> Settings:
    """Names are case-insensitive; unknown ones are logged and skipped.  n_list is the number of lists probed, and of clusters too, but for
    ivfpq-post, where it is how many lists there are; its pq_bits is the logarithm of the number of codes."""
    values, path, filter_dim = {}, "", 1
    own = _OWN.get(algorithm, {})
    kinds = {f.name: f.type for f in fields(Params)}
    for line in text.splitlines():
        name, equals, value = (part.strip() for part in line.partition("="))
        if not equals or name.startswith("#"):
            continue
        name = name.lower()
        param = own.get(name) or _PARAMS.get(name)
        if name == "path":
            path = value.strip("\"'")
        elif name == "filter_dim":
            filter_dim = int(value)
        elif param:
            number = float(value) if kinds[param] == "float" else int(value)
            values[param] = 1 << number if name == "pq_bits" else number
            if name == "n_list" and name not in own:
                values["cluster_probes"] = number
        else:
            log.warning("unknown setting %s is skipped", name)
    return Settings(path, filter_dim, replace(Params(), **values))


def parse_filters(text: str) -> list[Filter]:
    """The filters of ``l = N`` and its blocks ``filterI:``; a blank line ends a block, and # begins a comment outside them."""
    expected, blocks, block = None, {}, None
    for raw in text.splitlines():
        line = raw.strip()
        if not line:
            block = None
        elif block is None and line.startswith("#"):
            continue
        elif line.startswith("filter") and line.endswith(":"):
            block = blocks.setdefault(int(line[len("filter") : -1]), {})
        else:
            name, _, value = (part.strip() for part in line.partition("="))
            if name == "l" and block is None:
                expected = int(value)
            elif block is not None:
                block[name] = ast.literal_eval(value)
    if expected is None or sorted(blocks) != list(range(expected)):
        raise ValueError(f"l is {expected}, but the filters are {sorted(blocks)}")
    return [_filter(blocks[i]) for i in range(expected)]


def _filter(block: dict) -> Filter:
    kind = block.get("type")
    if kind == 0:
        left, right = block["shift_val"]
        return Shift(left, right)
    if kind == 1:
        ends = block["interval_map"]
        if len(ends) % 2:
            raise ValueError("interval_map needs two ends for each category")
        return IntervalMap(tuple(zip(map(float, ends[::2]), map(float, ends[1::2]))))
    if kind == 2:
        return Divide(int(block["div_value"][0]))
    if kind == 3:
        return Interval()
    raise ValueError(f"unknown filter type {kind!r}")
