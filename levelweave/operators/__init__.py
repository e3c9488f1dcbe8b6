"""Operators on matrices, graphs, trees and schedules."""
