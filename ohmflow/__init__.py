"""ohmflow — Spark-native sensor-risk analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``); the heavy lifting is left to Catalyst and the executors.
"""

__version__ = "0.1.0"
