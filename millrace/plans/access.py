"""Access rules from a JSON file: the first rule that fits decides, no rule denies."""

from __future__ import annotations

import json
import re
import time
from pathlib import Path

SECTIONS = ("catalogs", "schemas", "tables", "functions", "queries")


class AccessDenied(PermissionError):
    pass


class AccessPolicy:
    """``catalogs``, ``schemas``, ``tables``, ``functions`` and ``queries``, each a list of rules.

    Patterns of a rule are regular expressions for whole names; one that a rule lacks fits all.  The
    file is read again once it is older than ``refresh`` seconds.
    """

    def __init__(self, path: str, refresh: float = 2.0):
        self.path, self.refresh, self._read = Path(path), refresh, 0.0
        self._rules: dict[str, list[dict]] = {}

    def rules(self, section: str) -> list[dict] | None:
        if time.monotonic() - self._read >= self.refresh or not self._read:
            found = json.loads(self.path.read_text())
            if unknown := set(found) - set(SECTIONS):
                raise ValueError(f"unknown sections {sorted(unknown)}")
            self._rules, self._read = found, time.monotonic()
        return self._rules.get(section)

    def _first(self, section: str, **names: str) -> dict | None:
        """None: the section has no rule that fits; {}: there is no such section, and all is allowed."""
        rules = self.rules(section)
        if rules is None:
            return {}
        return next((r for r in rules if all(re.fullmatch(str(r.get(k, ".*")), v) for k, v in names.items())), None)

    def allows(self, user: str, catalog: str, schema: str, table: str, privilege: str) -> bool:
        rule = self._first("catalogs", user=user, catalog=catalog)
        if rule is None or rule.get("allow", "all") in ("none", False):
            return False
        if rule.get("allow") == "read-only" and privilege != "SELECT":
            return False
        rule = self._first("tables", user=user, catalog=catalog, schema=schema, table=table)
        return rule is not None and (not rule or privilege in rule.get("privileges", []) or "OWNERSHIP" in rule.get("privileges", []))

    def owns_catalog(self, user: str, catalog: str) -> bool:
        rule = self._first("catalogs", user=user, catalog=catalog)
        return rule is not None and rule.get("allow", "all") in ("all", True)

    def owns_schema(self, user: str, catalog: str, schema: str) -> bool:
        rule = self._first("schemas", user=user, catalog=catalog, schema=schema)
        return rule is not None and bool(rule.get("owner", not rule))

    def may_call(self, user: str, catalog: str, function: str, privilege: str = "EXECUTE") -> bool:
        rule = self._first("functions", user=user, catalog=catalog, function=function)
        return rule is not None and (not rule or privilege in rule.get("privileges", []))

    def may_query(self, user: str, action: str = "execute") -> bool:
        rule = self._first("queries", user=user)
        return rule is not None and (not rule or action in rule.get("allow", []))

    def require(self, user: str, catalog: str, schema: str, table: str, privilege: str) -> None:
        if not self.may_query(user) or not self.allows(user, catalog, schema, table, privilege):
            raise AccessDenied(f"{user or 'nobody'} may not {privilege} {schema}.{table}")
