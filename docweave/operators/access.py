"""Document visibility, question scopes, listings and lifecycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions import text as tx
from docweave.runtime import broadcast_if_small, materialize, ranked, salted_join, spread
from docweave.sources.metadata import source_type

ADMIN_ROLES = ("root", "kb_admin")
SHARED = "shared"
# Device classes; the last one applies to every device.
DEVICES = ("PLM", "Plus_500", "Plus_Pro", "LP", "通用")
COMMON_DEVICE = DEVICES[-1]


def is_shared(visibility="visibility") -> Column:
    """Anything but an explicit ``shared`` counts as restricted."""
    return F.lower(tx.strip(F.coalesce(tx.as_column(visibility), F.lit("")))) == SHARED


def is_admin(role="role") -> Column:
    return F.coalesce(tx.as_column(role).isin(*ADMIN_ROLES), F.lit(False))


def logical_role(role, is_kb_admin) -> Column:
    return F.when(tx.as_column(role) == "root", "root").when(tx.as_column(is_kb_admin), "kb_admin").otherwise("user")


def normalize_device(value) -> Column:
    """Device class in its fixed spelling; empty stays empty, unknown is NULL."""
    text = tx.strip(F.coalesce(tx.as_column(value), F.lit("")))
    known = F.coalesce(*[F.when(F.lower(text) == d.lower(), F.lit(d)) for d in DEVICES])
    return F.when(text == "", F.lit("")).otherwise(known)


def grant_classes(users: DataFrame, grants: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grants without a row per user and document.

    Users in the same groups form a class: people(user_id, class), listed(class, document_id) for the documents of their
    groups, extra(user_id, document_id) for direct grants of documents that the class does not list. No pair comes twice.
    """
    known = users.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    own = members.join(known, "user_id", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_set("group_id")).alias("class"))
    people = materialize(known.join(own, "user_id", "left").select("user_id", F.coalesce("class", F.array().cast(own.schema["class"].dataType)).alias("class")))
    groups = grants.where(F.col("subject_type") == "group").select(F.col("subject_id").alias("_group"), "document_id").distinct()
    listed = materialize(people.select("class").distinct().select("class", F.explode("class").alias("_group"))
                         .join(groups, "_group").select("class", "document_id").distinct())
    direct = (grants.where(F.col("subject_type") == "user").select(F.col("subject_id").alias("user_id"), "document_id").distinct()
              .join(people, "user_id"))
    held = listed.select(F.col("class").alias("_class"), F.col("document_id").alias("_document"))
    extra = direct.join(held, (F.col("class") == F.col("_class")) & F.col("document_id").eqNullSafe(F.col("_document")), "left_anti")
    return people, listed, extra.select("user_id", "document_id")


def granted_documents(users: DataFrame, grants: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, document_id) by direct or group grant. Shared documents are never listed per user.

    The pairs come out of the join distinct, so they are neither shuffled nor compared.
    """
    people, listed, extra = grant_classes(users, grants, members)
    listed = spread(listed, "document_id")
    by_group = listed.join(broadcast_if_small(people), "class").select("user_id", "document_id")
    return extra.unionByName(by_group)


def check_access(requests: DataFrame, users: DataFrame, documents: DataFrame, grants: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``visible`` to (user_id, document_id) requests; only the requested pairs are formed."""
    asked = requests.select("user_id", "document_id").distinct()
    direct = grants.where(F.col("subject_type") == "user").select(F.col("subject_id").alias("user_id"), "document_id")
    groups = grants.where(F.col("subject_type") == "group").select(F.col("subject_id").alias("group_id"), "document_id")
    by_group = asked.join(members.distinct(), "user_id").join(groups.distinct(), ["group_id", "document_id"], "left_semi").select("user_id", "document_id")
    granted = (asked.join(direct, ["user_id", "document_id"], "left_semi").unionByName(by_group).join(users.select("user_id"), "user_id", "left_semi")
               .distinct().withColumn("_granted", F.lit(True)))
    docs = documents.select("document_id", is_shared().alias("_shared"))
    people = users.select("user_id", is_admin().alias("_admin"))
    joined = requests.join(people, "user_id", "left").join(docs, "document_id", "left").join(granted, ["user_id", "document_id"], "left")
    known = F.col("_shared").isNotNull() & F.col("_admin").isNotNull()
    visible = known & (F.col("_admin") | F.col("_shared") | F.col("_granted").isNotNull())
    return joined.withColumn("visible", F.coalesce(visible, F.lit(False))).drop("_granted", "_shared", "_admin")


def visible_counts(users: DataFrame, documents: DataFrame, grants: DataFrame, members: DataFrame) -> DataFrame:
    """Number of visible documents per user without listing user and document pairs."""
    totals = documents.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(is_shared()).alias("n_shared"))
    restricted = documents.where(~is_shared()).select("document_id")
    people, listed, extra = grant_classes(users, grants, members)
    per_class = listed.join(restricted, "document_id", "left_semi").groupBy("class").agg(F.count(F.lit(1)).alias("_listed"))
    per_user = extra.join(restricted, "document_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("_extra"))
    own = people.join(per_class, "class", "left").join(per_user, "user_id", "left").select(
        "user_id", (F.coalesce("_listed", F.lit(0)) + F.coalesce("_extra", F.lit(0))).alias("_own"))
    everything, shared = totals.select("n_all").scalar(), totals.select("n_shared").scalar()
    return users.join(own, "user_id", "left").select(
        "user_id", is_admin().alias("unrestricted"),
        F.when(is_admin(), everything).otherwise(shared + F.coalesce("_own", F.lit(0))).cast("long").alias("visible_documents"))


@dataclass
class Scope:
    """Documents each question may use, without listing shared documents per question.

    ``queries(query_id, see_all, has_request)``; ``documents(document_id, shared)``;
    ``granted`` and ``requested`` hold explicit (query_id, document_id) pairs. A question with a
    request and no requested row sees nothing; an empty scope never widens.
    """

    queries: DataFrame
    documents: DataFrame
    granted: DataFrame
    requested: DataFrame

    def keep(self, hits: DataFrame) -> DataFrame:
        """Rows (query_id, document_id, ...) whose document is in the scope of their question."""
        rows = hits.join(self.queries, "query_id").join(self.documents, "document_id")
        pairs = ["query_id", "document_id"]
        rows = (rows.join(self.granted.withColumn("_granted", F.lit(True)), pairs, "left")
                .join(self.requested.withColumn("_requested", F.lit(True)), pairs, "left"))
        allowed = ((F.col("see_all") | F.col("shared") | F.col("_granted").isNotNull())
                   & (~F.col("has_request") | F.col("_requested").isNotNull()))
        return rows.where(allowed).select(*hits.columns)

    def per_document(self) -> DataFrame:
        """(document_id, shared, granted, requested) with the explicit question ids as arrays."""
        granted = self.granted.groupBy("document_id").agg(F.collect_set("query_id").alias("granted"))
        requested = self.requested.groupBy("document_id").agg(F.collect_set("query_id").alias("requested"))
        return self.documents.join(granted, "document_id", "left").join(requested, "document_id", "left")

    def of(self, queries: DataFrame) -> "Scope":
        """The scope of some of the questions."""
        ids = queries.select("query_id")
        return Scope(self.queries.join(ids, "query_id", "left_semi"), self.documents, self.granted.join(ids, "query_id", "left_semi"),
                     self.requested.join(ids, "query_id", "left_semi"))

    def pairs_per_document(self) -> int:
        """Largest number of explicit pairs that one document has."""
        pairs = self.granted.unionByName(self.requested).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        return pairs.agg(F.max("n").alias("n")).first()["n"] or 0

    def attach(self, rows: DataFrame, spread: str = "chunk_id") -> DataFrame:
        """Rows of a chunk table with the scope of their document."""
        return salted_join(rows, self.per_document(), ["document_id"], "inner", spread)

    @staticmethod
    def allows() -> Column:
        """Test for rows that carry an attached scope beside the question's own flags."""
        listed = lambda name: F.coalesce(F.array_contains(name, F.col("query_id")), F.lit(False))
        return (F.col("see_all") | F.col("shared") | listed("granted")) & (~F.col("has_request") | listed("requested"))


def open_scope(questions: DataFrame, documents: DataFrame) -> Scope:
    """Every question may use every document."""
    none = questions.sparkSession.createDataFrame([], "query_id long, document_id long")
    return Scope(questions.select("query_id", F.lit(True).alias("see_all"), F.lit(False).alias("has_request")),
                 documents.select("document_id", F.lit(True).alias("shared")), none, none)


def effective_scope(questions: DataFrame, users: DataFrame, documents: DataFrame, grants: DataFrame, members: DataFrame,
                    requested: DataFrame) -> Scope:
    """Requested documents of each question, cut to what its user may see.

    Questions: query_id, user_id. ``requested`` holds (query_id, document_id); a question without a
    row there asks for everything visible.
    """
    people = users.select("user_id", is_admin().alias("see_all"))
    asked = requested.select("query_id").distinct().withColumn("has_request", F.lit(True))
    # An unknown user sees nothing: the question counts as a request for no document.
    unknown = F.col("see_all").isNull()
    queries = (questions.select("query_id", "user_id").join(people, "user_id", "left").join(asked, "query_id", "left")
               .select("query_id", "user_id", F.coalesce("see_all", F.lit(False)).alias("see_all"),
                       (F.coalesce("has_request", F.lit(False)) | unknown).alias("has_request"), unknown.alias("_unknown")))
    requested = requested.join(queries.where("_unknown").select("query_id"), "query_id", "left_anti")
    asking = queries.where(~F.col("see_all")).select("query_id", "user_id")
    # Only the grants of users that ask become pairs.
    granted = granted_documents(users.join(asking, "user_id", "left_semi"), grants, members).join(asking, "user_id")
    # Every search step filters by the same scope.
    return Scope(materialize(queries.drop("user_id", "_unknown")), materialize(documents.select("document_id", is_shared().alias("shared"))),
                 materialize(granted.select("query_id", "document_id")), materialize(requested.select("query_id", "document_id").distinct()))


def requested_scope(scope: Scope) -> DataFrame:
    """Explicit (query_id, document_id) scope of the questions that requested documents."""
    return scope.keep(scope.requested)


def conversation_scope(turns: DataFrame) -> DataFrame:
    """Every turn keeps the scope of the first one; a differing request is a conflict.

    Turns: conversation_id, turn, requested (sorted array). The first turn is a partial aggregate.
    """
    first = turns.groupBy("conversation_id").agg(F.min_by("requested", "turn").alias("scope"))
    joined = salted_join(turns, first, ["conversation_id"], "inner", "turn")
    asks = F.size(F.coalesce("requested", F.array().cast("array<bigint>"))) > 0
    return joined.withColumn("conflict", asks & ~F.col("requested").eqNullSafe(F.col("scope")))


def active_scope(requests: DataFrame, documents: DataFrame, visible: DataFrame) -> DataFrame:
    """Status per requested document: ok, not_found (missing or invisible) or not_ready."""
    docs = documents.select("document_id", ((F.col("status") == "ready") & (F.col("lifecycle") == "active")).alias("_active"))
    seen = visible.where("visible").select("query_id", "document_id").distinct().withColumn("_seen", F.lit(True))
    joined = requests.join(docs, "document_id", "left").join(seen, ["query_id", "document_id"], "left")
    status = (F.when(F.col("_seen").isNull() | F.col("_active").isNull(), "not_found").when(~F.col("_active"), "not_ready").otherwise("ok"))
    return joined.select("query_id", "document_id", status.alias("status"))


def redact_history(turns: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns citing a document that is hidden now lose their answer; hidden citations disappear.

    Citations carry ``visible`` for the reader.
    """
    hidden = citations.where(~F.col("visible")).select("turn_id").distinct().withColumn("redacted", F.lit(True))
    rows = turns.join(hidden, "turn_id", "left").withColumn("redacted", F.coalesce("redacted", F.lit(False)))
    rows = rows.withColumn("answer", F.when(~F.col("redacted"), F.col("answer")))
    return rows, citations.where("visible")


def document_listing(documents: DataFrame, users: DataFrame, grants: DataFrame, jobs: DataFrame | None = None, version: str | None = None,
                     device: str | None = None, date_from: str | None = None, date_to: str | None = None, kind: str | None = None) -> DataFrame:
    """Administration list with grant counts; a specific device also shows the common documents."""
    rows = documents
    if version:
        rows = rows.where(F.col("version") == version)
    if device:
        rows = rows.where(F.col("device").isin(device, COMMON_DEVICE))
    if date_from:
        rows = rows.where(F.col("created_on") >= date_from)
    if date_to:
        rows = rows.where(F.col("created_on") <= date_to)
    metadata = F.col("source_metadata") if "source_metadata" in documents.columns else F.lit(None).cast("string")
    rows = rows.withColumn("source_type", source_type(metadata, "content_type", "filename"))
    if kind:
        rows = rows.where(F.col("source_type") == kind)
    counts = grants.groupBy("document_id").agg(
        F.count_if(F.col("subject_type") == "user").alias("granted_user_count"),
        F.count_if(F.col("subject_type") == "group").alias("granted_group_count"))
    names = users.select(F.col("user_id").alias("uploaded_by"), F.col("username").alias("uploaded_by_name"))
    rows = rows.join(counts, "document_id", "left").join(names, "uploaded_by", "left")
    if jobs is not None:
        rows = rows.join(jobs.select("document_id", F.col("state").alias("job_state")), "document_id", "left")
    return rows.withColumn("visibility", F.when(is_shared(), SHARED).otherwise("restricted")).fillna(
        0, ["granted_user_count", "granted_group_count"]).orderBy(F.col("document_id").desc())


def user_listing(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Visible, ready and active documents out of checked (user_id, document_id, visible) rows."""
    good = documents.where("status = 'ready' AND lifecycle = 'active'").select("document_id", "filename", "version", "device")
    return requests.where("visible").join(good, "document_id")


def group_overview(members: DataFrame, grants: DataFrame) -> DataFrame:
    """Members and number of granted documents per group."""
    people = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"), F.min("user_id").alias("first_member"), F.max("user_id").alias("last_member"))
    documents = (grants.where(F.col("subject_type") == "group").select(F.col("subject_id").alias("group_id"), "document_id").distinct()
                 .groupBy("group_id").agg(F.count(F.lit(1)).alias("document_count")))
    return people.join(documents, "group_id", "full").select(
        "group_id", F.coalesce("member_count", F.lit(0)).alias("member_count"), "first_member", "last_member",
        F.coalesce("document_count", F.lit(0)).alias("document_count"))


def group_members(members: DataFrame) -> DataFrame:
    """(group_id, user_id, position): the members of each group as rows, numbered by user; a large group is numbered bucket by bucket."""
    return ranked(members.select("group_id", "user_id").distinct(), ["group_id"], F.floor(F.col("user_id") / 1024), ["user_id"], "position")


def group_listing(groups: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """Every group with its own columns, its number of members and of granted documents; none is left out."""
    people = members.select("group_id", "user_id").distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"))
    documents = (grants.where(F.col("subject_type") == "group").select(F.col("subject_id").alias("group_id"), "document_id").distinct()
                 .groupBy("group_id").agg(F.count(F.lit(1)).alias("document_count")))
    return groups.join(people, "group_id", "left").join(documents, "group_id", "left").withColumns({
        name: F.coalesce(name, F.lit(0)) for name in ("member_count", "document_count")})


def grantable_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("role") != "root").select("user_id", "username", "role", "is_active").orderBy("username")


def user_groups(members: DataFrame) -> DataFrame:
    """Group ids per user; a user is in few groups."""
    return members.groupBy("user_id").agg(F.array_sort(F.collect_set("group_id")).alias("group_ids"))


def set_lifecycle(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """Outcome per change: the new lifecycle, or the reason of its refusal.

    Changes: document_id, lifecycle, replacement_document_id.
    """
    own = documents.select("document_id", F.col("status").alias("_status"), F.col("lifecycle").alias("_lifecycle"))
    target = documents.select(F.col("document_id").alias("replacement_document_id"),
                              ((F.col("status") == "ready") & (F.col("lifecycle") == "active")).alias("_usable"))
    joined = changes.join(own, "document_id", "left").join(target, "replacement_document_id", "left")
    link = F.col("replacement_document_id")
    reason = (F.when(F.col("_status").isNull(), "not_found")
              .when((F.col("lifecycle") == "active") & link.isNotNull(), "active_has_replacement")
              .when(F.col("_status") == "parsing", "parsing").when(link == F.col("document_id"), "self_replacement")
              .when(link.isNotNull() & ~F.coalesce("_usable", F.lit(False)), "replacement_not_usable"))
    return joined.withColumn("reason", reason).select(
        "document_id", F.when(F.col("reason").isNull(), F.col("lifecycle")).otherwise(F.col("_lifecycle")).alias("lifecycle"),
        F.when(F.col("reason").isNull(), link).alias("replacement_document_id"), "reason")
