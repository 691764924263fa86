import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fusionlens.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4, app_name="fusionlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def six_rows(spark):
    """Six builds, 25 of 27 contract columns (no gas flow, no melt-pool width), classes 2/1/2/1."""
    rows = [
        (1, "Ti-6Al-4V", "Spherical", "Island", 30.0, 0.10, 200.0, 900.0, 0.10, 30.0, 100.0, 150.0, 1600.0, 1.0e5, 92.5, 900.0,
         99.0, 1.0, 330.0, 5.0, 950.0, 850.0, 10.0, 9, "Poor"),
        (2, "Ti-6Al-4V", "Spherical", "Stripe", 32.0, 0.12, 250.0, 1200.0, 0.10, 30.0, 110.0, 160.0, 1650.0, 1.1e5, 69.4, 950.0,
         99.2, 0.8, 335.0, 4.5, 960.0, 860.0, 11.0, 10, "Poor"),
        (3, "Ti-5553", "Irregular", "Island", 28.0, 0.11, 300.0, 1100.0, 0.10, 50.0, 120.0, 170.0, 1700.0, 1.2e5, 54.5, 1000.0,
         99.4, 0.6, 340.0, 4.0, 970.0, 870.0, 12.0, 8, "Moderate"),
        (4, "Ti-5553", "Irregular", "Chessboard", 31.0, 0.13, 350.0, 1980.0, 0.10, 40.0, 130.0, 180.0, 1750.0, 1.3e5, 44.2,
         1050.0, 99.6, 0.4, 345.0, 3.5, 980.0, 880.0, 13.0, 6, "Good"),
        (5, "Ti-6Al-4V", "Spherical", "Stripe", 29.0, 0.14, 220.0, 765.0, 0.10, 30.0, 140.0, 190.0, 1800.0, 1.4e5, 95.9, 1100.0,
         99.8, 0.2, 350.0, 3.0, 990.0, 890.0, 14.0, 5, "Good"),
        (6, "Near-Beta Ti", "Spherical", "Island", 33.0, 0.15, 280.0, 1900.0, 0.10, 20.0, 150.0, 200.0, 1850.0, 1.5e5, 73.7,
         1150.0, 99.9, 0.1, 355.0, 2.5, 1000.0, 900.0, 15.0, 2, "Excellent"),
    ]
    schema = ("Sample_ID long, Alloy_Type string, Powder_Morphology string, Scan_Strategy string, Powder_Size_um double, "
              "Oxygen_Content_percent double, Laser_Power_W double, Scan_Speed_mm_s double, Hatch_Spacing_mm double, "
              "Layer_Thickness_um double, Preheat_Temp_C double, Melt_Pool_Depth_um double, Melt_Pool_Temp_C double, "
              "Cooling_Rate_K_s double, Energy_Density_J_mm3 double, Thermal_Gradient double, "
              "Relative_Density_percent double, Porosity_percent double, Microhardness_HV double, "
              "Surface_Roughness_Ra double, Tensile_Strength_MPa double, Yield_Strength_MPa double, "
              "Elongation_percent double, Defect_Count int, Quality_Class string")
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    formula = F.col("Laser_Power_W") / (F.col("Scan_Speed_mm_s") * F.col("Hatch_Spacing_mm")
                                        * (F.col("Layer_Thickness_um") / 1000.0))
    # observed energy density = formula with a small measurement offset
    return df.withColumn("Energy_Density_J_mm3", formula * (1.0 + 0.001 * (F.col("Sample_ID") % 2)))


@pytest.fixture(scope="session")
def builds_small(spark):
    from fusionlens.sources.builds import builds

    return builds(spark, SF, with_extras=True).cache()
