"""Masked views, pseudonyms, encryption with per-user keys, erasure, access decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions.pseudonym import mask, secret, token

VIEWS = {"Admin": "raw", "Analyst": "masked"}


def masked(df: DataFrame, salt: str, columns: tuple[str, ...] = ("user", "pc"), length: int = C.MASK_LENGTH) -> DataFrame:
    return df.withColumns({c: mask(F.col(c), salt, length) for c in columns if c in df.columns})


def role_view(df: DataFrame, role: str, salt: str) -> DataFrame:
    """Raw rows for Admin, masked rows for Analyst; everyone else is refused."""
    view = VIEWS.get(role)
    if view is None:
        raise PermissionError(f"role {role!r} is not allowed to view this data")
    return df if view == "raw" else masked(df, salt)


def token_map(df: DataFrame, key: bytes, salt: str, column: str = "user") -> DataFrame:
    """One token per distinct value: the table behind the controlled reverse lookup."""
    return df.select(column).distinct().withColumn("token", token(F.col(column), secret(df.sparkSession, key), salt))


def pseudonymised(df: DataFrame, key: bytes, salt: str, column: str = "user") -> DataFrame:
    """The token is a pure function of the value, so no join with the map is needed."""
    return df.withColumn(column, token(F.col(column), secret(df.sparkSession, key), salt))


def reverse_lookup(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Answer requests (token, claimed_id, operator, approver, justification).

    Four outcomes: no second approver, unknown token, claimed id does not match, success.
    """
    known = tokens.select("token", F.col("user").alias("__user"))
    joined = requests.join(known, "token", "left")
    wrong = (F.coalesce(F.col("claimed_id"), F.lit("")) != "") & (F.col("claimed_id") != F.col("__user"))
    error = (
        F.when(F.col("approver").isNull(), C.LOOKUP_ERRORS["approval"])
        .when(F.col("__user").isNull(), C.LOOKUP_ERRORS["unknown_token"])
        .when(wrong, C.LOOKUP_ERRORS["wrong_claim"])
    )
    return joined.withColumns({
        "success": error.isNull(), "recovered_id": F.when(error.isNull(), F.col("__user")), "error": error,
    }).drop("__user")


def audit_rows(answers: DataFrame, operation: str, at: Column) -> DataFrame:
    return answers.select(
        at.alias("timestamp"), F.lit(operation).alias("operation"), "operator",
        F.col("approver").alias("approved_by"), "justification", "success", "error",
    )


def user_keys(users: DataFrame, master: bytes, column: str = "user") -> DataFrame:
    """A 256-bit key per user. Here derived from a master key; a vault table has the same shape."""
    digest = F.unhex(F.sha2(F.concat(secret(users.sparkSession, master)["key"], F.encode(F.col(column), "UTF-8")), 256))
    return users.select(column).distinct().withColumn("user_key", digest)


def encrypted(df: DataFrame, keys: DataFrame, columns: list[str], user: str = "user") -> DataFrame:
    """Authenticated encryption of columns with the key of the row's user."""
    joined = df.join(keys, user, "left")
    return joined.withColumns({
        c: F.when(F.col("user_key").isNotNull(), F.aes_encrypt(F.encode(F.col(c).cast("string"), "UTF-8"), F.col("user_key"), F.lit("GCM")))
        for c in columns
    }).drop("user_key")


def decrypted(df: DataFrame, keys: DataFrame, columns: list[str], user: str = "user") -> DataFrame:
    """Back to text; rows of users without a key (erased ones) read as null."""
    joined = df.join(keys, user, "left")
    return joined.withColumns({
        c: F.decode(F.try_aes_decrypt(F.col(c), F.col("user_key"), F.lit("GCM")), "UTF-8") for c in columns
    }).drop("user_key")


def erase(keys: DataFrame, requests: DataFrame, user: str = "user") -> tuple[DataFrame, DataFrame]:
    """(keys without the erased users, audit rows saying whether a key existed)."""
    left = keys.join(requests.select(user), user, "left_anti")
    had = keys.select(user, F.lit(True).alias("success"))
    audit = requests.join(had, user, "left").withColumn("success", F.coalesce("success", F.lit(False)))
    return left, audit


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.ACCESS_POLICY, "role string, level int, can_deanonymize boolean, can_erase boolean")


def access_decisions(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """allowed and reason per request (role, resource, action, justification)."""
    joined = requests.join(F.broadcast(policy), "role", "left")  # four fixed rows
    unjustified = F.coalesce(F.col("justification"), F.lit("")) == ""
    reason = (
        F.when(F.col("level").isNull(), F.concat(F.lit("Unknown role: "), F.col("role")))
        .when((F.col("action") == "deanonymize") & ~F.col("can_deanonymize"), F.concat(F.lit("Role "), F.col("role"), F.lit(" cannot de-anonymize")))
        .when((F.col("action") == "erase") & ~F.col("can_erase"), F.concat(F.lit("Role "), F.col("role"), F.lit(" cannot erase")))
        .when(F.col("action").isin("deanonymize", "erase") & unjustified, "Justification required")
    )
    return joined.withColumns({"allowed": reason.isNull(), "reason": reason}).drop("level", "can_deanonymize", "can_erase")
