"""Text expressions, and a function that Spark lacks: the normal quantile."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented vowels and what stands for them.
ACCENTED, PLAIN = "áéíóúòàèìù", "aeiouoaeiu"


def stop_words(language: str = "spanish") -> list[str]:
    """Those that Spark brings along."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


#: Whole values that are kept together while words are dropped, and how they come back.
TOGETHER = {"definido": "nodefinido", "sin descripcion": "sindescripcion", "no definido": "nodefinido", "no aplica": "noaplica"}
APART = {"nodefinido": "no definido", "noaplica": "no aplica", "sindescripcion": "sin descripcion"}


def replaced(c: Column, values: dict[str, str]) -> Column:
    """Whole values by others."""
    return reduce(lambda out, pair: F.when(c == pair[0], F.lit(pair[1])).otherwise(out), values.items(), c)


def cleaned(c: Column, words: list[str] | None = None, keep_marks: bool = False) -> Column:
    """Lower case; emoticons go, and marks (keep_marks: only the comma, the hyphen and two odd ones); no accents; without
    stop words; one space between words. Null stays."""
    low = replaced(F.lower(c), TOGETHER)
    plain = F.regexp_replace(low, r"[:;=]-?[()]", "")
    plain = F.regexp_replace(plain, "[,´�-]" if keep_marks else r"[\p{Punct}´�]", "")
    plain = F.translate(plain, ACCENTED, PLAIN)
    parts = F.filter(F.split(plain, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    drop = stop_words() if words is None else words
    if drop:
        parts = F.filter(parts, lambda w: ~w.isin(drop))
    return F.when(c.isNotNull(), replaced(F.array_join(parts, " "), APART))


def encoded(c: Column) -> Column:
    """Base64 of the value's text; a stand-in for encryption. Null stays."""
    return F.replace(F.base64(F.encode(c.cast("string"), "UTF-8")), F.lit("\r\n"), F.lit(""))


def encrypted(c: Column, key: Column) -> Column:
    """AES of the value's text under a key of 16, 24 or 32 bytes, as base64."""
    return F.base64(F.aes_encrypt(F.encode(c.cast("string"), "UTF-8"), key))


def masked(c: Column) -> Column:
    """Beyond three characters, the first two and three stars."""
    text = c.cast("string")
    return F.when(F.length(text) > 3, F.concat(F.substring(text, 1, 2), F.lit("***"))).otherwise(text)


#: The coefficients of Wichura's rational approximations to the normal quantile (algorithm AS 241), from
#: the highest power down, for the middle, for the tails, and for the far tails.
MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def ratio(coefficients: tuple, r):
    top, bottom = (reduce(lambda total, k: total * r + k, own[1:], own[0]) for own in coefficients)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function, to sixteen digits."""
    q = p - 0.5
    t = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    size = F.when(t <= 5, ratio(TAIL, t - 1.6)).otherwise(ratio(FAR, t - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * size)


def to_normal(marks: list[float]):
    """A function of a Column: its place among the marks (evenly spaced quantiles), as a normal deviate. Runs of
    equal marks count by their middle; the ends are clipped."""
    from .stats import place

    n = len(marks)

    def share(v: Column) -> Column:
        if n == 1:
            return F.lit(0.5)
        table = F.array(*map(F.lit, marks))
        upto, under = place(v, marks), F.size(table) - place(-v, [-m for m in reversed(marks)])  # marks at most v, and under v
        low, high = F.get(table, upto - 1), F.get(table, upto)
        between = (upto - 1 + (v - low) / (high - low)) / (n - 1)
        return F.when(upto > under, (under + upto - 1) / 2 / (n - 1)).when(upto == 0, 0.0).when(upto == n, 1.0).otherwise(between)

    def run(c: Column) -> Column:
        clipped = F.least(F.greatest(share(c), F.lit(1e-7)), F.lit(1 - 1e-7))
        return F.when(c.isNotNull(), F.get(F.transform(F.array(clipped), normal_quantile), F.lit(0)))

    return run
