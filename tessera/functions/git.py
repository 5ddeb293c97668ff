"""Addresses of repositories as column expressions: where they are, whose they are, and what of them may be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SSH = r"^git@([^:/]+):(.+?)(?:\.git)?$"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@]*@)?([^/:?#]*)(?::\d+)?([^?#]*)"


def host(url: Column) -> Column:
    return F.when(url.rlike(SSH), F.lower(F.regexp_extract(url, SSH, 1))).otherwise(F.lower(F.regexp_extract(url, URL, 2)))


def parts(url: Column) -> Column:
    """The segments of an address' path, without the ending .git."""
    path = F.when(url.rlike(SSH), F.regexp_extract(url, SSH, 2)).otherwise(F.regexp_extract(url, URL, 3))
    return F.filter(F.split(F.regexp_replace(path, r"\.git/?$", ""), "/"), lambda s: s != "")


def provider(url: Column) -> Column:
    h = host(url)
    at = lambda name: (h == f"{name}.com") | h.endswith(f".{name}.com")
    local = F.startswith(F.lower(url), F.lit("file://")) | h.isin("", "localhost", "127.0.0.1")
    return F.when(local, "local").when(at("github"), "github").when((h == "gitlab.com") | F.contains(h, F.lit("gitlab")), "gitlab").otherwise("git")


def owner(url: Column) -> Column:
    return F.when(F.size(parts(url)) >= 2, F.get(parts(url), F.lit(0))).otherwise("")


def repository(url: Column) -> Column:
    """The second segment; that is what follows the owner on the hosts that show pages of a repository."""
    return F.when(F.size(parts(url)) >= 2, F.get(parts(url), F.lit(1))).otherwise("")


def looks_like_repository(url: Column) -> Column:
    """Whether an address is a repository's or a page of one, rather than documentation to crawl."""
    u, h = F.trim(url), host(F.trim(url))
    hosted = (h == "github.com") | h.endswith(".github.com") | F.contains(h, F.lit("gitlab"))
    return F.lower(u).endswith(".git") | u.rlike("^git@") | u.rlike("(?i)^(ssh|git)://") | (hosted & (F.size(parts(u)) >= 2))


def clone_url(url: Column) -> Column:
    """What to clone for an address that was given, pages of a repository included."""
    u = F.trim(url)
    base = F.concat(F.lower(F.regexp_extract(u, URL, 1)), F.lit("://"), host(u), F.lit("/"), owner(u), F.lit("/"), repository(u), F.lit(".git"))
    two = F.size(parts(u)) >= 2
    return F.when(u.rlike(SSH) | F.startswith(F.lower(u), F.lit("file://")), u).when((provider(u) == "github") & two, F.concat(F.lit("https://github.com/"), owner(u), F.lit("/"), repository(u), F.lit(".git"))).when(two, base).otherwise(F.regexp_replace(u, r"[?#].*$", ""))


def redacted(text: Column) -> Column:
    """An address without the credentials in it."""
    return F.regexp_replace(text, r"^(.*?://)[^@]*[:%][^@]*@", "$1***@")


def picked_ref(name: Column) -> Column:
    """The order in which refs of a remote that fit a name are picked: a peeled tag, a branch, another tag, the rest."""
    return F.when(name.rlike(r"^refs/tags/.*\^\{\}$"), 0).when(name.rlike("^refs/heads/"), 1).when(name.rlike("^refs/tags/"), 2).otherwise(3)
