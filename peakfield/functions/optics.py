"""The contrast transfer of a microscope as columns. Lengths are in angstroms unless named otherwise, angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wavelength(kilovolts: Column) -> Column:
    """Relativistic wavelength of electrons."""
    volts = kilovolts * 1000.0
    return F.lit(12.2639) / F.sqrt(volts * (1.0 + volts * 0.97845e-6))


def contrast_phase(amplitude: Column) -> Column:
    """Phase shift, in radians, that stands for the share of amplitude contrast."""
    return F.when(F.abs(amplitude - 1.0) < 1e-3, math.pi / 2).otherwise(F.atan(amplitude / F.sqrt(F.greatest(1.0 - amplitude * amplitude, F.lit(1e-12)))))


def defocus_at(first: Column, second: Column, angle: Column, azimuth: Column) -> Column:
    """Defocus in a direction (azimuth in radians)."""
    return (first + second + F.cos((azimuth - F.radians(angle)) * 2) * (first - second)) / 2


def transfer(fx: Column, fy: Column, pixel: Column, kilovolts: Column, aberration_mm: Column, amplitude: Column, first: Column, second: Column, angle: Column, phase_shift: Column) -> Column:
    """Contrast transfer at a frequency in cycles per pixel; without any defocus it is -0.7."""
    square = fx * fx + fy * fy
    wave = wavelength(kilovolts) / pixel
    spherical = aberration_mm * 1e7 / pixel
    defocus = defocus_at(first / pixel, second / pixel, angle, F.atan2(fy, fx))
    phase = wave * math.pi * square * (defocus - wave * wave * square * spherical / 2) + F.radians(phase_shift) + contrast_phase(amplitude)
    return F.when((first == 0) & (second == 0), -0.7).otherwise(-F.sin(phase))
