"""What is known of the connection that a mail came by: given values first, else read from its headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions import urls
from postsieve.functions.patterns import let


def _first_received(lines: Column) -> Column:
    return urls.header(lines, "received")


def for_rules(from_address: Column, lines: Column, client_host: Column | None = None, remote: Column | None = None) -> Column:
    """struct<from_address, from_domain, from_root, client_host, root_client_host, remote_address>, as the rules read it.

    A given client host comes without a root host, which only a host read from the headers has.
    """
    none = F.lit(None).cast("string")
    client_host, remote = (none if c is None else F.nullif(c, F.lit("")) for c in (client_host, remote))

    def over(x: Column) -> Column:
        low, read = x["low"], urls.received_host(x["received"])
        domain = F.when(F.instr(low, "@") > 1, urls.host_of_address(low))
        return F.struct(
            low.alias("from_address"), domain.alias("from_domain"), urls.root_domain_rules(domain).alias("from_root"), F.coalesce(client_host, read).alias("client_host"),
            F.when(client_host.isNull(), urls.root_domain_rules(read)).alias("root_client_host"), F.coalesce(remote, urls.received_ip(x["received"])).alias("remote_address"),
        )

    return let(F.struct(F.nullif(F.lower(from_address), F.lit("")).alias("low"), _first_received(lines).alias("received")), over)


def for_attributes(from_address: Column, to: Column, cc: Column, lines: Column, client_host: Column | None = None, remote: Column | None = None) -> Column:
    """struct as for_rules, with forwarding rewrites of the sender undone, root hosts of given client hosts, and an envelope (mail_from, rcpt_to)
    read from the headers."""
    none = F.lit(None).cast("string")
    client_host, remote = (none if c is None else F.nullif(c, F.lit("")) for c in (client_host, remote))

    def over(x: Column) -> Column:
        low, host = x["low"], F.coalesce(client_host, urls.received_host(x["received"]))
        domain = urls.host_of_address_or_domain(low)
        return F.struct(
            low.alias("from_address"), domain.alias("from_domain"), urls.root_domain_attributes(domain).alias("from_root"), host.alias("client_host"),
            urls.root_domain_attributes(host).alias("root_client_host"), F.coalesce(remote, urls.received_ip(x["received"])).alias("remote_address"),
            F.coalesce(low, F.lit("")).alias("mail_from"), F.concat(urls.address_list(to), urls.address_list(cc)).alias("rcpt_to"),
        )

    return let(F.struct(F.nullif(F.lower(urls.undo_srs(from_address)), F.lit("")).alias("low"), _first_received(lines).alias("received")), over)
