"""Haplotype model of genotypes as DataFrame expressions.

haplotypes: (j, k, r, alpha, theta), a row for each variant and each of the K ancestral haplotypes: distance to the variant
before, share of the haplotype, chance of its allele 1. An unordered pair (a, b), a <= b, of haplotypes is a hidden state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_index(a: Column, b: Column, k: int) -> Column:
    """Number of the pair a <= b, from 1, pairs in order of a and then b."""
    return ((a - 1) * k - F.floor((a - 1) * (a - 2) / 2) + b - a + 1).cast("int")


def index_pair(i: Column, k: int) -> Column:
    """The pair a <= b of a number from 1, as a struct: what pair_index undoes."""
    firsts = F.array(*[F.lit((a - 1) * k - (a - 1) * (a - 2) // 2) for a in range(1, k + 1)])
    a = F.size(F.filter(firsts, lambda f: f < i))
    return F.struct(a.alias("a"), (i - F.get(firsts, a - 1) + a - 1).cast("int").alias("b"))


def likelihood_ratio(theta_a: Column, theta_b: Column, rho: Column, alpha: float = 0.1) -> Column:
    """Score of a pair of haplotypes at a variant of allele share rho, a share alpha of the variants being decorrelated."""
    none, one, both = (1 - theta_a) * (1 - theta_b), theta_a * (1 - theta_b) + theta_b * (1 - theta_a), theta_a * theta_b
    odds = (1 - rho) * (1 - rho) / none * 2 * rho * (1 - rho) / one * rho * rho / both
    return F.log(F.lit(1 - alpha)) + alpha / (1 - alpha) * odds


def pairs(haplotypes: DataFrame) -> DataFrame:
    """(j, a, b, alpha_a, alpha_b, theta_a, theta_b), a <= b."""
    side = lambda s: haplotypes.select("j", F.col("k").alias(s), F.col("alpha").alias(f"alpha_{s}"), F.col("theta").alias(f"theta_{s}"))
    return side("a").join(side("b"), "j").where("a <= b")


def haplotype_transitions(haplotypes: DataFrame) -> DataFrame:
    """(j, a, b, p): from haplotype a at the variant before to b at j."""
    stay = F.exp(-F.col("r"))
    both = haplotypes.select("j", F.col("k").alias("a")).join(haplotypes.select("j", F.col("k").alias("b"), "r", "alpha"), "j")
    return both.select("j", "a", "b", ((1 - stay) * F.col("alpha") + F.when(F.col("a") == F.col("b"), stay).otherwise(0.0)).alias("p"))


def genotype_transitions(haplotypes: DataFrame) -> DataFrame:
    """(j, a, b, c, d, p): from the pair a <= b to the pair c <= d; both ways to reach an unequal pair add up."""
    t = haplotype_transitions(haplotypes)
    one, two = t.select("j", "a", F.col("b").alias("x"), F.col("p").alias("p1")), t.select("j", F.col("a").alias("b"), F.col("b").alias("y"), F.col("p").alias("p2"))
    ways = one.join(two, "j").where("a <= b")
    return ways.groupBy("j", "a", "b", F.least("x", "y").alias("c"), F.greatest("x", "y").alias("d")).agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))


def initial(haplotypes: DataFrame) -> DataFrame:
    """(j, a, b, p): shares of the pairs at each variant."""
    p = F.col("alpha_a") * F.col("alpha_b")
    return pairs(haplotypes).select("j", "a", "b", F.when(F.col("a") == F.col("b"), p).otherwise(2 * p).alias("p"))


def genotype_emissions(haplotypes: DataFrame) -> DataFrame:
    """(j, a, b, x, p): chance of genotype x = 0, 1, 2 from each pair."""
    a, b = F.col("theta_a"), F.col("theta_b")
    chances = F.array((1 - a) * (1 - b), a * (1 - b) + (1 - a) * b, a * b)
    return pairs(haplotypes).select("j", "a", "b", F.posexplode(chances).alias("x", "p"))


def haplotype_emission(theta: Column, allele: Column) -> Column:
    """Chance of allele 0 or 1; any other is an error."""
    return F.when(allele == 1, theta).when(allele == 0, 1 - theta).otherwise(F.raise_error(F.lit("alleles are 0 or 1")).cast("double"))
