"""When to bring which services up to date: cadence, backlog, busiest first, back-off when idle; and its state on disk."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

STATE_VERSION = 2


@dataclass
class ServiceState:
    """How far a service's log was read and materialised, and what waits."""

    inode: int = 0
    offset: int = 0
    sequence: int = 0
    materialized_offset: int = 0
    pending_fragments: int = 0
    pending_events: int = 0

    def read_to(self, inode: int, end: int, events: int) -> bool:
        """Take note of newly read bytes; True if the file was rotated or truncated, which starts it anew."""
        anew = bool(self.inode and inode != self.inode) or end < self.offset
        if anew:
            self.__init__(inode=inode)
        if end > self.offset:
            self.sequence += 1
            self.pending_fragments += 1
            self.pending_events += events
        self.inode, self.offset = inode, end
        return anew

    def materialized(self) -> None:
        self.materialized_offset, self.pending_fragments, self.pending_events = self.offset, 0, 0


class LiveState:
    """States of all services in one JSON file, replaced as a whole.

    A file of version 1 held sizes only: these are offsets that were read and
    materialised.  A damaged file is as none, a damaged service is left out.
    """

    def __init__(self, path: str):
        self.path, self.services = path, {}
        try:
            with open(path) as f:
                data = json.load(f)
        except (OSError, ValueError):
            return
        if not isinstance(data, dict):
            return
        names = {f.name for f in fields(ServiceState)}
        if int(data.get("version") or 1) == 1:
            for name, size in (data.get("last_log_size") or {}).items():
                try:
                    self.services[name] = ServiceState(offset=int(size), materialized_offset=int(size))
                except (TypeError, ValueError):
                    continue
            return
        for name, body in (data.get("services") or {}).items():
            try:
                self.services[name] = ServiceState(**{k: int(v) for k, v in body.items() if k in names})
            except (AttributeError, TypeError, ValueError):
                continue

    def get(self, service: str) -> ServiceState:
        return self.services.setdefault(service, ServiceState())

    def save(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(f"{self.path}.tmp", "w") as f:
            json.dump({"version": STATE_VERSION, "updated_at": time.time(), "services": {k: asdict(v) for k, v in self.services.items()}}, f, indent=2, sort_keys=True)
        os.replace(f"{self.path}.tmp", self.path)


@dataclass
class Scheduler:
    """Decides at each tick what is materialised, whether the registry is rebuilt, and how long to wait."""

    every_ticks: int = 6
    most_fragments: int = 32
    services_per_cycle: int = 3
    registry_every: int = 6
    base_interval_s: float = 5.0
    idle_interval_s: float = 60.0
    backoff: float = 2.0
    idle_before_backoff: int = 3
    ticks: int = 0
    idle: int = 0
    rounds: int = 0
    interval_s: float = field(default=5.0)

    def tick(self, pending: Mapping[str, ServiceState], read: bool) -> tuple[list[str], bool]:
        """(services to materialise, busiest first; whether the registry is due) given the services with something waiting and whether this tick read anything."""
        self.ticks += 1
        waiting = {k: v for k, v in pending.items() if v.pending_fragments}
        due = self.ticks % self.every_ticks == 0 or any(v.pending_fragments >= self.most_fragments for v in waiting.values())
        chosen = sorted(waiting, key=lambda k: (-waiting[k].pending_events, k))[: self.services_per_cycle] if due else []
        rebuild = False
        if chosen:
            self.rounds += 1
            rebuild = self.rounds >= self.registry_every
            self.rounds = 0 if rebuild else self.rounds
        if read:
            self.idle, self.interval_s = 0, self.base_interval_s
        else:
            self.idle += 1
            if self.idle >= self.idle_before_backoff:
                self.interval_s = min(self.interval_s * self.backoff, self.idle_interval_s)
        return chosen, rebuild
