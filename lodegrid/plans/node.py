"""Nodes: lazily built operator plans, evaluated at coordinates.

A node holds attributes and input nodes. ``eval`` compiles the whole tree to one DataFrame plan; nothing
runs until an action. Nodes are immutable, equal by content hash, and have a JSON form in which equal
sub-plans appear once and inputs come before their users.
"""

from __future__ import annotations

import hashlib
import importlib
import json
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.plans.coordinates import Coordinates, GroupCoordinates
from lodegrid.plans.coverage import Coverage
from lodegrid.plans.settings import settings


class NodeException(Exception):
    pass


REGISTRY: dict[str, type[Node]] = {}


class Request:
    """What is asked for, and a memo of sub-plans already built for it."""

    def __init__(self, coords: Coordinates, spark: SparkSession):
        self.coords, self.spark, self.memo = coords, spark, {}
        #: Whether the cells are neighbours for an interpolation, so that a source may not narrow points to the box.
        self.neighbours = False
        #: Dimensions along which an interpolation carries values on ("previous", "zero" or "next"), however far.
        self.open: dict[str, str] = {}

    def frame(self, dims: list[str] | None = None) -> DataFrame:
        """The request's cells, over the given dimensions only (whole stacks if one member is wanted)."""
        parts = [p for p in self.coords.parts if dims is None or p.name in dims or (hasattr(p, "dims") and set(p.dims) & set(dims))]
        return Coordinates(parts, crs=self.coords.crs).frame(self.spark)

    def at(self, coords: Coordinates) -> Request:
        return Request(coords, self.spark)


class Node:
    """Subclasses name their attributes in ``attributes`` (with defaults) and their inputs in ``inputs``."""

    attributes: dict[str, object] = {}
    input_names: tuple[str, ...] = ("source",)
    #: Whether keyword arguments beyond the attributes are inputs.
    open_inputs = False

    def __init_subclass__(cls, **kw: object) -> None:
        super().__init_subclass__(**kw)
        REGISTRY[cls.__name__] = cls

    def __init__(self, **kw: object):
        values = dict(self.attributes)
        inputs: dict[str, object] = {}
        for k, v in kw.items():
            if k in ("style", "units", "outputs"):
                values[k] = v
            elif k in self.input_names or isinstance(v, Node):
                if k not in self.input_names and not self.open_inputs and k not in values:
                    raise TypeError(f"{type(self).__name__} has no attribute {k!r}")
                inputs[k] = v
            elif k in values:
                values[k] = v
            else:
                raise TypeError(f"{type(self).__name__} has no attribute {k!r}")
        object.__setattr__(self, "attrs", values)
        object.__setattr__(self, "inputs", inputs)
        self.check()

    def __setattr__(self, name: str, value: object) -> None:
        raise AttributeError("nodes do not change; build another")

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("attrs", "inputs"):
            raise AttributeError(name)
        if name in self.inputs:
            return self.inputs[name]
        if name in self.attrs:
            return self.attrs[name]
        raise AttributeError(f"{type(self).__name__} has no attribute {name!r}")

    def check(self) -> None:
        """Validate attributes; evaluation problems show when evaluating."""

    # -- evaluation ---------------------------------------------------------------------------
    def compile(self, request: Request) -> Coverage:
        """The plan of this node for a request; equal nodes share one."""
        key = (self.hash, request.coords.hash)
        if key not in request.memo:
            made = self.build(request)
            if self.attrs.get("units") and settings["ENABLE_UNITS"]:
                made = made.with_attrs(units=self.attrs["units"])
            request.memo[key] = made
        return request.memo[key]

    def build(self, request: Request) -> Coverage:
        raise NotImplementedError

    def eval(self, coordinates: Coordinates, spark: SparkSession | None = None, output: str | None = None) -> Coverage:
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        out = self.compile(Request(coordinates, spark))
        if output is not None:
            out = out.select(output)
        order = [d for d in coordinates.udims if d in out.dims]
        return out.transpose(*order).with_attrs(crs=coordinates.crs, style=self.attrs.get("style"))

    def eval_group(self, group: GroupCoordinates, spark: SparkSession | None = None) -> Coverage:
        """All requests of a group, under a ``group_id``."""
        parts = [self.eval(c, spark) for c in group.items]
        df = None
        for i, p in enumerate(parts):
            one = p.df.withColumn("group_id", F.lit(i))
            df = one if df is None else df.unionByName(one)
        return parts[0].with_df(df.select("group_id", *parts[0].dims, *parts[0].outputs), dims=["group_id", *parts[0].dims])

    def find_coordinates(self) -> list[Coordinates]:
        return [c for n in self.inputs.values() if isinstance(n, Node) for c in n.find_coordinates()]

    def get_bounds(self) -> dict[str, list]:
        out: dict[str, list] = {}
        for c in self.find_coordinates():
            for d, (lo, hi) in c.bounds.items():
                out[d] = [min(lo, out[d][0]), max(hi, out[d][1])] if d in out else [lo, hi]
        return out

    def nodes(self) -> list[Node]:
        """The plan's nodes, inputs first, each once."""
        seen: dict[str, Node] = {}

        def walk(n: Node) -> None:
            for i in n._children():
                walk(i)
            seen.setdefault(n.hash, n)

        walk(self)
        return list(seen.values())

    def _children(self) -> list[Node]:
        out = []
        for v in self.inputs.values():
            out += [v] if isinstance(v, Node) else [x for x in v if isinstance(x, Node)] if isinstance(v, (list, tuple)) else []
        return out

    def probe(self, spark: SparkSession | None = None, **point: object) -> list[dict]:
        """Evaluate every node of the plan at one point: name (of the style, else the node's), value and its label,
        whether the node is active (sources that a compositor passes over are not, nor what only they use), inputs, hash."""
        coords = Coordinates([[v] for v in point.values()], dims=list(point))
        out, values = {}, {}
        for n in self.nodes():
            style = n.attrs.get("style") or {}
            style = style if isinstance(style, dict) else vars(style)
            try:
                row = n.eval(coords, spark).df.head()
                dims = set(row.asDict()) & set(coords.udims) if row is not None else set()
                values[n.hash] = [] if row is None else [v for k, v in row.asDict().items() if k not in dims]
                value = None if row is None else row[len(row) - 1]
            except (ValueError, KeyError) as bad:
                value, values[n.hash] = f"{type(bad).__name__}: {bad}", []
            legend = {int(k): v for k, v in (style.get("enumeration_legend") or {}).items()}
            label = legend.get(int(value), style.get("default_enumeration_legend", "unknown")) if legend and isinstance(value, float) else None
            out[n.hash] = {"name": style.get("name") or type(n).__name__, "value": value, "label": label, "active": False, "inputs": [c.hash for c in n._children()], "node_hash": n.hash}

        def mark(n: Node) -> None:
            out[n.hash]["active"] = True
            sources = list(n.inputs.get("sources") or []) if hasattr(n, "active") else []
            used = n.active([values[s.hash] for s in sources]) if sources else None
            for c in n._children():
                if not any(c is s for s in sources) or used is not None and c is sources[used]:
                    mark(c)

        mark(self)
        return list(out.values())

    def interpolate(self, interpolation: object = "nearest") -> Node:
        return REGISTRY["Interpolate"](source=self, interpolation=interpolation)

    def cache(self, kind: str = "hash", **kw: object) -> Node:
        return REGISTRY["PartialCache" if kind == "partial" else "HashCache"](source=self, **kw)

    # -- identity and JSON --------------------------------------------------------------------
    @property
    def definition(self) -> dict[str, dict]:
        """{reference: {node, attrs, inputs}}, inputs first; nodes of one hash share a reference."""
        out: dict[str, dict] = {}
        known: dict[str, str] = {}

        def put(n: Node, above: tuple[int, ...]) -> str:
            if id(n) in above:
                raise NodeException("a plan must not contain itself")
            if n.hash in known:
                return known[n.hash]
            refs: dict[str, object] = {}
            for k, v in n.inputs.items():
                refs[k] = put(v, (*above, id(n))) if isinstance(v, Node) else [put(x, (*above, id(n))) for x in v]
            base = name = type(n).__name__
            i = 0
            while name in out:
                i += 1
                name = f"{base}_{i}"
            entry: dict[str, object] = {"node": type(n).__name__ if type(n).__module__.startswith("lodegrid") else f"{type(n).__module__}:{type(n).__name__}"}
            plain = {k: _plain(v) for k, v in n.attrs.items() if k != "style" and v is not None and v != n.attributes.get(k)}
            entry |= ({"attrs": plain} if plain else {}) | ({"inputs": refs} if refs else {}) | ({"style": n.attrs["style"]} if n.attrs.get("style") else {})
            out[name] = entry
            known[n.hash] = name
            return name

        put(self, ())
        return out

    @property
    def json(self) -> str:
        return json.dumps(self.definition, separators=(",", ":"))

    @property
    def hash(self) -> str:
        made = self.__dict__.get("_hash")
        if made is None:
            parts = {k: _plain(v) for k, v in self.attrs.items() if k != "style"}
            refs = {k: v.hash if isinstance(v, Node) else [x.hash for x in v] for k, v in self.inputs.items()}
            text = json.dumps([type(self).__name__, parts, refs], separators=(",", ":"), sort_keys=True)
            made = hashlib.md5(text.encode()).hexdigest()
            object.__setattr__(self, "_hash", made)
        return made

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and self.hash == other.hash

    def __hash__(self) -> int:
        return int(self.hash[:15], 16)

    def save(self, path: str) -> None:
        Path(path).write_text(self.json)

    @classmethod
    def load(cls, path: str) -> Node:
        return cls.from_json(Path(path).read_text())

    @classmethod
    def from_json(cls, text: str) -> Node:
        return cls.from_definition(json.loads(text))

    @classmethod
    def from_definition(cls, definition: dict[str, dict], output: str | None = None) -> Node:
        """Build a plan; inputs may stand in any order, unknown keys are errors. The last node is the result,
        or the one named by ``output`` or by the entry "output_node"."""
        entries = {k: v for k, v in definition.items() if k != "output_node"}
        built: dict[str, Node] = {}

        def make(name: str, above: tuple[str, ...]) -> Node:
            if name in above:
                raise NodeException(f"circular definition at {name!r}")
            if name not in entries:
                raise ValueError(f"no node {name!r} in the definition")
            if name not in built:
                d = entries[name]
                if bad := set(d) - {"node", "attrs", "inputs", "lookup_attrs", "style"}:
                    raise ValueError(f"unknown keys {sorted(bad)} at {name!r}")
                refs = {k: make(r, (*above, name)) if isinstance(r, str) else [make(x, (*above, name)) for x in r] for k, r in d.get("inputs", {}).items()}
                looked = {k: _lookup(make(p.split(".")[0], (*above, name)), p.split(".")[1:]) for k, p in d.get("lookup_attrs", {}).items()}
                style = {"style": d["style"]} if "style" in d else {}
                built[name] = _class(d["node"])(**d.get("attrs", {}), **looked, **refs, **style)
            return built[name]

        if not entries:
            raise ValueError("an empty definition")
        for name in entries:
            make(name, ())
        return built[output or definition.get("output_node") or list(entries)[-1]]

    @classmethod
    def from_name_params(cls, name: str, params: dict | None = None) -> Node:
        return _class(name)(**(params or {}))

    @classmethod
    def from_url(cls, url: str) -> Node:
        """The node of a WMS or WCS request: LAYERS, LAYER or COVERAGE is a node's name or "%PARAMS%" with a
        JSON plan in PARAMS."""
        q = {k.upper(): v[0] for k, v in parse_qs(urlparse(url).query).items()}
        layer = next((q[k] for k in ("LAYERS", "LAYER", "COVERAGE") if k in q), None)
        if layer is None:
            raise ValueError("the request names no layer")
        params = json.loads(q["PARAMS"]) if q.get("PARAMS") else {}
        return cls.from_definition(params) if layer == "%PARAMS%" else cls.from_name_params(layer, params)

    def __repr__(self) -> str:
        shown = ", ".join([f"{k}={v!r}" for k, v in self.attrs.items() if v is not None and v != self.attributes.get(k)][:4])
        return f"<{type(self).__name__}({shown})>"


def _class(name: str) -> type[Node]:
    if ":" in name:  # a plug-in: "package.module:Class"
        module, _, item = name.partition(":")
        return getattr(importlib.import_module(module), item)
    if name not in REGISTRY:
        raise ValueError(f"unknown node {name!r}")
    return REGISTRY[name]


def _lookup(node: object, path: list[str]) -> object:
    for p in path:
        node = getattr(node, p)
    return node


def _plain(v: object) -> object:
    """JSON's view of an attribute."""
    if isinstance(v, Coordinates):
        return {"__coordinates": v.definition()}
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, (np.datetime64, np.timedelta64)):
        return str(v)
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, DataFrame):
        return {"__table": hashlib.md5(v._jdf.queryExecution().analyzed().toString().encode()).hexdigest()}
    if isinstance(v, (bytes, bytearray)):
        return {"__bytes": hashlib.md5(v).hexdigest()}
    if callable(v):
        return {"__callable": f"{getattr(v, '__module__', '')}.{getattr(v, '__qualname__', repr(v))}"}
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def coordinates_of(v: object) -> Coordinates:
    """Coordinates from an attribute: themselves, their JSON or definition."""
    if isinstance(v, Coordinates):
        return v
    if isinstance(v, str):
        return Coordinates.from_json(v)
    if isinstance(v, dict):
        return Coordinates.from_definition(v.get("__coordinates", v))
    raise TypeError(f"not coordinates: {v!r}")


def describe_operators() -> dict[str, dict]:
    """A catalogue of node types: attributes with defaults, inputs, and the first line of their text."""
    return {n: {"attributes": {k: _plain(v) for k, v in c.attributes.items()}, "inputs": list(c.input_names), "doc": (c.__doc__ or "").strip().split("\n")[0]} for n, c in sorted(REGISTRY.items())}
