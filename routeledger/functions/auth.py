"""Authentication predicates over configurable word lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, WORD_EDGE, contains_any

Words = "list[str] | Column"

# The default word lists.
KEYWORDS = ["jwt", "login", "auth", "token", "security", "permission", "verify", "secure"]
DEPENDENCY_CALLABLES = ["Depends", "Security"]
DEPENDENCY_HINTS = [
    "current_user", "currentuser", "current_active", "get_current",
    "active_user", "authenticated", "oauth", "apikey", "api_key",
    "bearer", "scope", "principal",
]
SPRING_ANNOTATIONS = [
    "PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed", "PreFilter", "PostFilter",
]
EXPRESS_MIDDLEWARE = [
    "auth", "authenticate", "requireauth", "requirelogin", "ensureauthenticated",
    "ensureloggedin", "isauthenticated", "passport", "verifytoken", "checkjwt",
    "jwtcheck", "protect", "authguard", "authorize",
]

DEFAULT_LISTS = {
    "keywords": KEYWORDS,
    "python_dependency_callables": DEPENDENCY_CALLABLES,
    "python_auth_dependency_hints": DEPENDENCY_HINTS,
    "spring_auth_annotations": SPRING_ANNOTATIONS,
    "express_auth_middleware": EXPRESS_MIDDLEWARE,
}

# A dependency call and the callable inside it.
DEPENDENCY_CALL = rf"{WORD_EDGE}(Depends|Security)\({SPACE}*([A-Za-z_][\p{{L}}\p{{N}}_.]*)"
IDENTIFIER = r"^[A-Za-z_$][\p{L}\p{N}_$.]*\z"


@dataclass
class AuthRules:
    """The lists in force: Python lists (defaults) or array columns (one per repo)."""

    keywords: Words
    python_auth_dependency_hints: Words
    spring_auth_annotations: Words
    express_auth_middleware: Words

    @classmethod
    def defaults(cls) -> "AuthRules":
        return cls(KEYWORDS, DEPENDENCY_HINTS, SPRING_ANNOTATIONS, EXPRESS_MIDDLEWARE)

    @classmethod
    def from_columns(cls, prefix: str = "cfg_") -> "AuthRules":
        return cls(
            F.col(prefix + "keywords"),
            F.col(prefix + "python_auth_dependency_hints"),
            F.col(prefix + "spring_auth_annotations"),
            F.col(prefix + "express_auth_middleware"),
        )

    def keyword(self, name: Column) -> Column:
        return contains_any(name, self.keywords)

    def dependency(self, name: Column) -> Column:
        return self.keyword(name) | contains_any(name, self.python_auth_dependency_hints)

    def expression(self, expr: Column) -> Column:
        """A dependency call on an authentication-like callable occurs in ``expr``."""
        named = F.regexp_extract_all(expr, F.lit(DEPENDENCY_CALL), F.lit(2))
        return F.coalesce(F.exists(named, self.dependency), F.lit(False))

    def annotation(self, name: Column) -> Column:
        return contains_any(name, self.spring_auth_annotations)

    def middleware(self, name: Column) -> Column:
        return contains_any(name, self.express_auth_middleware) | self.keyword(name)

    def handler_argument(self, arg: Column) -> Column:
        """A factory call counts by its callee, a bare name by itself, ``a.b`` never."""
        called = F.regexp_extract(F.substring_index(arg, "(", 1), r"([^.]*)\z", 1)
        name = F.when(arg.contains("("), F.trim(called)).when(
            ~arg.contains(".") & arg.rlike(IDENTIFIER), arg
        )
        return self.middleware(name)
