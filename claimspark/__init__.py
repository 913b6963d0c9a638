"""claimspark: claim analytics as ordinary Spark DataFrame operators."""

__version__ = "0.1.0"
