"""rainweft: ensemble raster nowcasting, verification and large-table data preparation on Spark."""

__version__ = "0.1.0"
