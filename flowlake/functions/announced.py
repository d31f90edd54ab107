"""Reading template sets: all of an Arrow batch at once, one step of the walk for every set at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT_SHORT = "template cut short"
#: Spark type of the templates of a message.
TEMPLATES = (
    "array<struct<set_ix:int,set_id:int,rec_ix:int,template_id:int,"
    "fields:array<struct<element_id:int,length:int,enterprise:bigint,scope:boolean>>>>"
)


def _list(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _struct(**columns) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _ints(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, kind or pa.int32())


def read_announced(payload: pa.Array, sets: pa.Array, template_set: int, option_set: int, enterprise: bool) -> tuple[pa.Array, pa.Array]:
    """Per message the templates that its sets announce, in order, and an error if one of them is cut short.

    Every round reads one template header or one field of each set that is not at its end; positions count in bytes.
    """
    begins = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1].astype(np.int64)
    data = np.frombuffer(payload.buffers()[2] or b"\0", np.uint8)
    parent, flat = pc.list_parent_indices(sets).to_numpy(), pc.list_flatten(sets)
    set_ix = np.arange(len(parent)) - np.searchsorted(parent, parent)
    set_id, off, size = (pc.struct_field(flat, name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("set_id", "off", "len"))
    chosen = np.flatnonzero((set_id == template_set) | (set_id == option_set))
    parent, set_ix, set_id, size = parent[chosen], set_ix[chosen], set_id[chosen], size[chosen]
    start, end, options = begins[parent] + off[chosen], size - size % 2, set_id == option_set
    pos, need, scope, tid, count, done, short = (np.zeros(len(chosen), np.int64) for _ in range(7))

    def number(at: np.ndarray, of: np.ndarray) -> np.ndarray:
        place = start[of] + at
        high, low = (data[np.minimum(place + k, len(data) - 1)].astype(np.int64) for k in (0, 1))
        return high * 256 + low

    specs, ends = [], []  # of fields: set, template, place, id, length, enterprise; of templates: set, template, id, fields
    total = np.zeros(len(chosen), np.int64)  # templates that a set has ended
    live = np.arange(len(chosen))
    while len(live):
        at = pos[live]
        one, two, three = (number(at + 2 * k, live) for k in range(3))
        private = (one >= 32768) & enterprise
        width, left = np.where(private, 8, 4), end[live] - at
        inside = need[live] > 0
        field = inside & (left >= width)
        over = ~inside & ((size[live] - at <= 4) | (one == 0))
        head = np.where(options[live], 6, 4)
        cut = (inside & ~field) | (~inside & ~over & (left < head))
        opens = ~inside & ~over & ~cut
        if field.any():
            f, own = live[field], private[field]
            owner = number(at[field] + 4, f) * 65536 + number(at[field] + 6, f)
            element = one[field] & 32767 if enterprise else one[field]
            specs.append((f, total[f], count[f], element, two[field], np.where(own, owner, 0), count[f] < scope[f]))
            pos[f] += width[field]
            count[f] += 1
            need[f] -= 1
            last = f[need[f] == 0]
            ends.append((last, total[last], tid[last], count[last]))
            total[last] += 1
        if opens.any():
            f, option = live[opens], options[live[opens]]
            if enterprise:
                fields, scopes = two[opens], np.where(option, three[opens], 0)
            else:
                fields = np.where(option, two[opens] // 4 + three[opens] // 4, two[opens])
                scopes = np.where(option, two[opens] // 4, 0)
            pos[f] += head[opens]
            need[f], scope[f], tid[f], count[f] = fields, scopes, one[opens], 0
            empty = f[fields == 0]
            ends.append((empty, total[empty], tid[empty], count[empty]))
            total[empty] += 1
        short[live[cut]] = 1
        done[live[over | cut]] = 1
        live = live[done[live] == 0]

    none = np.zeros(0, np.int64)
    t_set, t_ix, t_id, t_fields = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (none,) * 4
    order = np.lexsort((t_ix, t_set))
    t_set, t_ix, t_id, t_fields = t_set[order], t_ix[order], t_id[order], t_fields[order]
    s = [np.concatenate(x) for x in zip(*specs, strict=True)] if specs else [none] * 7
    whole = s[1] < total[s[0]] if len(chosen) else np.zeros(0, bool)  # fields of a template that is cut short go
    s = [x[whole] for x in s]
    order = np.lexsort((s[2], s[1], s[0]))
    element, length, owner, scoped = (x[order] for x in s[3:])
    fields = _struct(element_id=_ints(element), length=_ints(length), enterprise=_ints(owner, pa.int64()), scope=pa.array(scoped.astype(bool)))
    found = _struct(
        set_ix=_ints(set_ix[t_set]), set_id=_ints(set_id[t_set]), rec_ix=_ints(t_ix), template_id=_ints(t_id), fields=_list(t_fields, fields)
    )
    templates = _list(np.bincount(parent[t_set], minlength=len(payload)), found)
    bad = np.bincount(parent, weights=short, minlength=len(payload)) > 0
    return templates, pa.array(np.where(bad, CUT_SHORT, None).tolist(), pa.string())
