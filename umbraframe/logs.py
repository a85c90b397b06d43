"""Two channels: what the engine does, without any text of a user; and a trace that may hold texts and goes nowhere by default."""

from __future__ import annotations

import logging

LOG = logging.getLogger("umbraframe")
TRACE = logging.getLogger("umbraframe.trace")
for _channel in (LOG, TRACE):
    _channel.addHandler(logging.NullHandler())
#: Nothing that sets up logging for all makes texts visible: a sink is attached to this channel on purpose, in code.
TRACE.propagate = False
