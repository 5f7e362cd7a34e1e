"""Ready-made Spark analytics jobs over tables, route problems, image files and job streams."""

__version__ = "0.1.0"
