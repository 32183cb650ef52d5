"""Raw sensor readings to physical values, as column expressions for bulk recalibration jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sensor characteristics
ADC_MAX = 4095.0
ADC_VOLT = 3.3
TDS_CUBIC = (133.42, -255.86, 857.39)
TDS_HALF = 0.5
TDS_TEMP_STEP = 0.02
LUX_DIVISOR = 1.2
LUX_DIVISOR_MODE2 = 2.4
TC_MV_PER_COUNT = 0.0078125
TC_MV_PER_DEGREE = 0.041276
DS_RANGE = (-55.0, 125.0)
TWO_20 = 1048576.0


def tds(raw: Column, temp: Column, k: float | Column = 1.0) -> Column:
    """Dissolved solids (ppm) from an ADC count, compensated to 25 degrees."""
    v = raw / F.lit(ADC_MAX) * F.lit(ADC_VOLT) / (F.lit(1.0) + F.lit(TDS_TEMP_STEP) * (temp - F.lit(25.0)))
    cubic, square, linear = TDS_CUBIC
    return (v * v * v * cubic + v * v * square + v * linear) * F.lit(TDS_HALF) * k


def soil(raw: Column, dry: Column, wet: Column) -> Column:
    """Soil moisture in percent between the dry and the wet count; null without a calibration span."""
    pct = F.lit(100.0) * (dry - raw) / F.nullif(dry - wet, F.lit(0).cast("double"))
    return F.when(pct.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct)))


def lux(raw: Column, fine: Column) -> Column:
    return F.when(fine, raw / F.lit(LUX_DIVISOR_MODE2)).otherwise(raw / F.lit(LUX_DIVISOR))


def aht(data: Column) -> tuple[Column, Column]:
    """Humidity (percent) and air temperature from the 6-byte frame: two 20-bit numbers after the status byte."""
    bits = F.conv(F.hex(F.substring(data, 2, 5)), 16, 10).cast("long")
    h = F.shiftright(bits, 20)
    t = bits.bitwiseAND(F.lit(0xFFFFF))
    ready = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0x80)) == 0
    return F.when(ready, h / TWO_20 * 100.0), F.when(ready, t / TWO_20 * 200.0 - 50.0)


def _shr(c: Column, n: int) -> Column:
    return F.shiftright(c, n)


def _trunc_div(a: Column, b: Column) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", a, b)


def compensate_bmp(df: DataFrame, calib: DataFrame, device: str = "node_id", raw_t: str = "adc_t", raw_p: str = "adc_p") -> DataFrame:
    """Pressure (Pa) and temperature from raw counts and the device's 12 coefficients T1..T3, P1..P9.

    The integer steps of the sensor's data sheet, in 64 bits. ``calib`` holds one row per device; the join is
    left to the optimizer, which broadcasts it only below its size limit.
    """
    j = df.join(calib, device, "left")
    c = {n: F.col(n).cast("long") for n in ("T1", "T2", "T3", *[f"P{i}" for i in range(1, 10)])}
    t, p = F.col(raw_t).cast("long"), F.col(raw_p).cast("long")
    coarse = _shr((_shr(t, 3) - c["T1"] * 2) * c["T2"], 11)
    off = _shr(t, 4) - c["T1"]
    j = j.withColumn("_fine", coarse + _shr(_shr(off * off, 12) * c["T3"], 14))
    x = F.col("_fine") - 128000
    j = j.withColumn("_scale", _shr((F.lit(1 << 47) + _shr(x * x * c["P3"], 8) + x * c["P2"] * 4096) * c["P1"], 33))
    j = j.withColumn("_shift", x * x * c["P6"] + x * c["P5"] * 131072 + c["P4"] * F.lit(1 << 35))
    j = j.withColumn("_p", _trunc_div(((F.lit(1048576) - p) * F.lit(1 << 31) - F.col("_shift")) * 3125,
                                      F.nullif(F.col("_scale"), F.lit(0).cast("long"))))
    q = F.col("_p")
    fine = _shr(c["P9"] * _shr(q, 13) * _shr(q, 13), 25)
    final = _shr(q + fine + _shr(c["P8"] * q, 19), 8) + c["P7"] * 16
    j = j.withColumn("bmp_temp", _shr(F.col("_fine") * 5 + 128, 8) / 100.0)
    j = j.withColumn("pressure", F.when(F.col("_scale") == 0, F.lit(0.0)).otherwise(final / 256.0))
    return j.drop("_fine", "_scale", "_shift", "_p", *c)


def leaf_from_thermocouple(raw: Column, air: Column) -> Column:
    return air + raw * F.lit(TC_MV_PER_COUNT) / F.lit(TC_MV_PER_DEGREE)


def one_wire(msb: Column, lsb: Column) -> tuple[Column, Column]:
    """Temperature of a signed 16-bit sixteenth-degree count, and whether it is in the measuring range."""
    word = msb * 256 + lsb
    temp = F.when(word >= 32768, word - 65536).otherwise(word) / 16.0
    return temp, temp.between(*DS_RANGE)


def mac_id(mac: Column) -> Column:
    """Device number: the last four bytes of the MAC, big-endian."""
    digits = F.regexp_replace(mac, "[^0-9A-Fa-f]", "")
    return F.conv(F.substring(digits, -8, 8), 16, 10).cast("long")
