"""How readings are spread over tasks for the ordered steps.

``slot``   one exchange on (vehicle, slot), where a slot is the shortest stretch of time in which
           every bin nests (2 h at the standard widths). All windows and roll-ups then run without
           another exchange, and a vehicle with a third of all rows is cut into its slots.
``slice``  rows are exchanged on (vehicle, sensor bin), 10 s at the standard widths. What a row
           needs from outside its slice (last earlier reading, best voltage of the hour) comes from
           a table of slice facts that is far smaller than the rows. For fleets where even a single
           slot of one vehicle is too big for a task.
The caller names the layout; ``slot`` is the standard, and both give the same rows.
"""

from __future__ import annotations

from ..params import Params


def settle(p: Params) -> Params:
    """The parameters, if their layout goes with their widths."""
    if p.layout == "slice" and any(w % p.sensor_s for w in (p.pre_s, p.period_s, p.gap_s, p.diff_s)):
        raise ValueError("the slice layout needs every width to be a multiple of sensor_s")
    return p
